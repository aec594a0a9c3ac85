"""Covariance in exact fractions, whitened values and odd vectors of op12."""
import math
import random
from fractions import Fraction

import numpy as np

from routekit.llm import whitening


def entries(vector):
    return [math.floor(1024 * Fraction(c)) + 100000 for c in vector]


def exact(vectors):
    n, d = len(vectors), len(vectors[0])
    s = [sum(v[k] for v in vectors) for k in range(d)]
    v = [[Fraction(sum((n * a[i] - s[i]) * (n * a[j] - s[j]) for a in vectors), n ** 3) for j in range(d)] for i in range(d)]
    return n, s, np.array([[float(x) for x in row] for row in v])


def check(frame, kept, **options):
    """`kept`: {id: vector} of the rows that stay."""
    xs = {k: entries(v) for k, v in kept.items()}
    n, s, v = exact(list(xs.values()))
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    rows = whitening.whitened(frame, **options).collect()
    assert len(rows) == len(kept) * min(8, len(s)) and {r.vec_id for r in rows} == set(kept)
    found = {(r.vec_id, r.component): r for r in rows}
    for c in range(1, min(8, len(s)) + 1):
        mine = np.array([found[(k, c)].whitened for k in xs])
        want = np.array([sum((x - m / n) * a for x, m, a in zip(xs[k], s, axes[:, c - 1])) for k in xs]) / math.sqrt(values[c - 1])
        assert np.allclose(mine, want, atol=1e-7) or np.allclose(mine, -want, atol=1e-7)
    for r in rows:
        assert r.n == n and r.deviation == sum((n * x - m) ** 2 for x, m in zip(xs[r.vec_id], s)) and r.deviation_digits == str(r.deviation)
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(v), rel_tol=1e-9) and r.identity_error < 1e-9
    return rows


def test_against_fractions(spark):
    deal = random.Random(3)
    base = [[deal.gauss(0, 1 + j) for j in range(4)] for _ in range(300)]
    kept = {k: [float(np.float32(v)) for v in (a[0], a[1] + 0.5 * a[0], a[2], a[3], a[0] - a[3], deal.random(), 7 * deal.random(), deal.gauss(0, 2), deal.random(), -3 * deal.random())] for k, a in enumerate(base)}
    odd = [(900, None), (901, [1.0] * 9 + [None]), (902, [float("nan")] + [0.0] * 9), (903, [float("inf")] + [0.0] * 9), (904, [0.0] * 9 + [float("-inf")])]
    frame = spark.createDataFrame([(k, v, "n", "v") for k, v in [*kept.items(), *odd]], "vec_id long, embedding array<float>, n string, vector string").repartition(7)
    check(frame, kept)


def test_large_entries_stay_exact(spark):
    deal = random.Random(4)
    kept = {k: [deal.choice([1e9, -3e11, 5.5]) * deal.random(), deal.random(), 2.0 ** 40 * deal.random()] for k in range(60)}
    xs = {k: entries(v) for k, v in kept.items()}
    n, s, v = exact(list(xs.values()))
    rows = whitening.whitened(spark.createDataFrame(list(kept.items()), "vec_id long, embedding array<double>")).collect()
    for r in rows:
        d = sum((n * x - m) ** 2 for x, m in zip(xs[r.vec_id], s))
        assert r.deviation_digits == str(d) and r.deviation == (d if d < 1 << 63 else None)
    values = np.linalg.eigvalsh(v)[::-1]
    assert all(math.isclose(r.explained, values[r.component - 1] / np.trace(v), rel_tol=1e-6, abs_tol=1e-15) for r in rows)
    huge = whitening.whitened(spark.createDataFrame([(1, [1e308, 0.0]), (2, [-1e308, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 4 and all(r.identity_error < 1e-4 for r in huge)


def test_short_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whitened(spark.createDataFrame([(None, [1.0, 2.0])], schema)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(None, 1, 1, 0, None, None, 0.0), (None, 2, 1, 0, None, None, 0.0)]
    rows = [(1, [1.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (4, []), (5, [0.5, 0.25])]
    got = whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    padded = [entries((v + [0.0, 0.0])[:2]) for _, v in rows]
    n, s, _ = exact(padded)
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted((k, sum((n * x - m) ** 2 for x, m in zip(p, s))) for (k, _), p in zip(rows, padded))
