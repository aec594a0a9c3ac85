"""Targets, dual and copies of op11 against brute force."""
import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from routekit.llm import mixing


def by_hand(sizes):
    """{source: (size, target)} by resharing what is above three times a source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not above:
            return target | share
        target |= {s: 3 * sizes[s] for s in above}
        left -= sum(3 * sizes[s] for s in above)
        open_ -= above
    return target


def root(sizes, target):
    """Rates min(3, exp(l size)) that add up to the target, by bisection."""
    low, high = -50.0, 50.0
    for _ in range(300):
        middle = (low + high) / 2
        total = sum(s * math.exp(min(math.log(3), middle * s)) for s in sizes)
        low, high = (middle, high) if total < target else (low, middle)
    return [math.exp(min(math.log(3), low * s)) for s in sizes]


def test_mix(spark):
    deal = random.Random(5)
    docs = [(k, s, " ".join(["w"] * deal.choice([1, 2, 3, 5, 8, 13, 40, deal.randint(1, 300)])), "x", 1) for k in range(1500) for s in [deal.choice(["a", "a", "a", "B", "ä", "z" * 3, "b", None, "c"])]]
    docs += [(9000, "tiny", "one two", "x", 1), (9001, "empty", None, "x", 1), (9001, "empty", " \n", "x", 1), (None, "a", "w w w", "x", 1), (None, "a", "w w w", "x", 1), (5, "b", "w w", "x", 1), (5, "b", "w w", "x", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, mark string, size int").repartition(5)
    got = mixing.mix(frame).collect()
    assert len(got) == len(docs)
    size = lambda text: len((text or "").split())
    of = defaultdict(list)
    for k, s, t, *_ in docs:
        of[s].append(size(t))
    target = by_hand({s: sum(v) for s, v in of.items()})
    rates = {s: dict(zip(v, root(v, target[s]))) for s, v in of.items() if 0 < target[s] < 3 * sum(v)}
    source = {(k, size(t)): s for k, s, t, *_ in docs}
    taken = defaultdict(int)
    for r in got:
        s = source[(r.doc_id, r.size)] if r.doc_id is not None else "a"
        assert r.source_size == sum(of[s]) and math.isclose(r.target, target[s], rel_tol=1e-12)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        if s in rates and r.size:
            assert math.isclose(r.rate, rates[s][r.size], rel_tol=1e-5) and abs(r.copies - r.rate) < 2 + 1e-6
        elif s == "tiny":
            assert r.taken == 6
        taken[s] += r.taken
    assert {s: (taken[s], target[s]) for s in of if s not in ("tiny", "empty") and abs(taken[s] - target[s]) > 5} == {} and taken["empty"] == 0
    counts = defaultdict(set)
    for r in got:
        counts[(r.source_size, r.size)].add(r.copies)
    assert all(max(v) - min(v) <= 1 for v in counts.values())
    again = mixing.mix(frame.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_odd_tables(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    nothing = mixing.mix(spark.createDataFrame([(1, None, None), (2, None, "")], schema)).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in nothing} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    long = "w " * 200_000
    got = mixing.mix(spark.createDataFrame([(1, "a", long), (2, "b", "x y"), (3, "b", "x")], schema)).collect()
    assert sum(r.taken for r in got if r.doc_id > 1) == 9 and next(r for r in got if r.doc_id == 1).copies in (0, 1)


def test_one_hot_size(spark):
    """A group of equal copies takes exactly its rate, dealt over slices."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit("one two three four").alias("text"))
    got = mixing.mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 4 for r in got) and len(got) == 2
