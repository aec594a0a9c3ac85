"""Whitening of embeddings by a polarised covariance.

Every entry c becomes the integer x = floor(1024 c) + 100000. One pass sums x per dimension; with n vectors and sums S the
integer centre is m = floor(S / n) and the rest r = S - n m. The next pass adds up exact squares of the centred values
d = x - m: of every dimension and of every sum of two dimensions. Since (a + b)^2 - a^2 - b^2 = 2ab, the differences of
these give all cross products, and n * sum(d_i d_j) - r_i r_j over n^2 is the covariance, in integers until the one
division. Its unit eigenvectors (eigh, the largest entry of each positive) project the vectors.

Tasks work on blocks of rows in numpy, with 64-bit integers where these can't overflow and Python's integers elsewhere.
The driver gets n, one sum per dimension, one per pair of dimensions and one per pair of components, whatever the rows.

Cases: vectors that are null or hold null or non-finite entries are dropped; vectors shorter than the longest have zeros for
their missing entries; x stays within the range of long; rows that repeat are fitted and returned each; rows with a null id
are fitted and returned with a null id; a component whose eigenvalue is not above 1e-13 of the largest (one vector only,
constant dimensions) has a null `whitened`, and `explained` is null where all vectors are equal; `deviation` is null beyond
the range of long, `deviation_digits` always holds it; a table without vectors, or with empty ones only, gives an empty
result; other columns are left alone.
"""
from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routekit.llm.common import query, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
ROWS = 4096  # of a block
SMALL = 1 << 23  # (2 * SMALL)^2 * ROWS is below 2^63
LIMB = 10 ** 18
LONG = (-(1 << 63), (1 << 63) - 1)
FEW = "k int, high decimal(38,0), low decimal(38,0)"
ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double, deviation_digits string"


def blocks(batches, width: int | None = None):
    """(ids, x): ids and integer vectors of the rows that stay, at most ROWS at a time, in rows of `width` or as they come."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            vectors = part.column("vector")
            length = vectors.value_lengths()
            there = np.asarray(length.is_valid())
            size = np.asarray(length.fill_null(0)).astype(np.int64)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries are NaN here
            end = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            fine = there & (bad[end] == bad[end - size])
            if not fine.any():
                continue
            of_row = np.repeat(np.arange(len(size)), size)
            held = fine[of_row]
            x = integers(values[held])
            rows = np.cumsum(fine) - 1
            columns = np.arange(len(values)) - np.repeat(end - size, size)
            out = np.full((int(fine.sum()), int(size[fine].max(initial=0)) if width is None else width), SHIFT, dtype=x.dtype)
            out[rows[of_row[held]], columns[held]] = x
            yield part.column("vec_id").filter(pa.array(fine)), out, size[fine]


def integers(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = np.floor(c * SCALE)
    if np.abs(scaled).max(initial=0) < SMALL:
        return scaled.astype(np.int64) + SHIFT
    exact = [(int(v) if np.isfinite(v) else (LONG[1] if v > 0 else LONG[0])) + SHIFT for v in scaled]
    return np.array([min(max(v, LONG[0]), LONG[1]) for v in exact], dtype=object)


def centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x - centre, in 64-bit integers where sums of ROWS squares of two entries fit."""
    fits = x.dtype != object and max(map(abs, centre), default=0) < 1 << 40
    d = x - np.array(centre, dtype=np.int64 if fits else object)
    return d if fits and np.abs(d).max(initial=0) < SMALL else d.astype(object)


def limbs(keys, totals) -> pa.RecordBatch:
    high, low = zip(*(divmod(int(t), LIMB) for t in totals)) if len(totals) else ((), ())
    decimal = lambda values: pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(list(keys), pa.int32()), decimal(high), decimal(low)], ["k", "high", "low"])


def collected(partial: DataFrame) -> dict[int, int]:
    """The exact sum of each key's totals."""
    rows = partial.groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {r["k"]: int(r["high"]) * LIMB + int(r["low"]) for r in rows}


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of every dimension."""
    def work(batches):
        n, total, here = 0, np.zeros(0, dtype=object), np.zeros(0, dtype=object)
        for _, x, size in blocks(batches):
            grow = max(0, x.shape[1] - len(total))
            total, here = (np.concatenate([v, np.zeros(grow, dtype=object)]) for v in (total, here))
            n += len(x)
            held = np.arange(x.shape[1])[None, :] < size[:, None]
            total[:x.shape[1]] += np.where(held, x, 0).sum(axis=0).astype(object)
            here[:x.shape[1]] += held.sum(axis=0).astype(object)
        if n:  # key 0 is n; odd keys are sums, even ones the number of entries there
            yield limbs([0, *range(1, 2 * len(total) + 1)], [n, *(v for pair in zip(total, here) for v in pair)])

    found = collected(vectors.mapInArrow(work, FEW))
    n, width = found.get(0, 0), len(found) // 2
    return n, [found[2 * k + 1] + SHIFT * (n - found[2 * k + 2]) for k in range(width)]


def squares(vectors: DataFrame, centre: list[int]) -> dict[int, int]:
    """Key i * width + j: the sum over all vectors of d_i^2 where i = j, of (d_i + d_j)^2 where i < j."""
    width = len(centre)
    keys = [i * width + j for i in range(width) for j in range(i, width)]

    def work(batches):
        total = np.zeros(len(keys), dtype=object)
        for _, x, _ in blocks(batches, width):
            d = np.asfortranarray(centred(x, centre))
            at = 0
            for i in range(width):
                pair = d[:, i:] + d[:, i:i + 1]
                pair[:, 0] = d[:, i]
                total[at:at + width - i] += ((pair * pair).sum(axis=0) if d.dtype == object else np.einsum("ij,ij->j", pair, pair)).astype(object)
                at += width - i
        if total.any():
            yield limbs(keys, total)

    return collected(vectors.mapInArrow(work, FEW))


def covariance(n: int, rest: list[int], found: dict[int, int]) -> np.ndarray:
    """Differences of variances: cov(i, j) = (var(i + j) - var(i) - var(j)) / 2, each exact over n^2 before it is a double."""
    width = len(rest)
    var = lambda i, j: n * found.get(i * width + j, 0) - (rest[i] if i == j else rest[i] + rest[j]) ** 2  # n^2 times the variance
    own = [var(i, i) for i in range(width)]
    out = np.empty((width, width))
    for i in range(width):
        out[i, i] = own[i] / n ** 2
        for j in range(i + 1, width):
            out[i, j] = out[j, i] = (var(i, j) - own[i] - own[j]) / (2 * n ** 2)
    return out


def projected(d: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (d.astype(np.float64) - mean) @ axes


def identity_error(vectors: DataFrame, n: int, centre: list[int], mean: np.ndarray, axes: np.ndarray) -> float:
    """The largest entry of (covariance of the whitened vectors - identity); a pass over all of them, added up in decimals."""
    k = axes.shape[1]
    if not k:
        return 0.0
    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def work(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for _, x, _ in blocks(batches, len(centre)):
            w = projected(centred(x, centre), mean, axes)
            total += w.sum(axis=0)
            products += w.T @ w
        values = [Decimal(float(v)).quantize(Decimal("1e-15")) for v in [*total, *(products[a, b] for a, b in pairs)]]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.decimal128(38, 15))], ["k", "total"])

    rows = vectors.mapInArrow(work, "k int, total decimal(38,15)").groupBy("k").agg(F.sum("total").alias("total")).collect()
    found = {r["k"]: float(r["total"]) / n for r in rows}
    return max(abs(found[k + at] - found[a] * found[b] - (a == b)) for at, (a, b) in enumerate(pairs))


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector that stays and component: see the contract's columns in ROW, and identity_error."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    n, total = sums(vectors)
    if not total:
        return spark.createDataFrame([], f"{ROW}, identity_error double")
    centre, rest = [s // n for s in total], [s % n for s in total]
    v = covariance(n, rest, squares(vectors, centre))
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None, :], 0) < 0, -1.0, 1.0)
    sound = values > 1e-13 * max(values[0], 0)
    mean, scaled = np.array([r / n for r in rest]), axes[:, sound] / np.sqrt(values[sound])
    trace = float(np.trace(v))
    explained = [float(e) / trace if trace > 0 else None for e in values]
    error, k = identity_error(vectors, n, centre, mean, scaled), len(values)
    square_rest = sum(r * r for r in rest)
    narrow = max(rest) < 1 << 30

    def work(batches):
        for ids, x, _ in blocks(batches, len(centre)):
            d = centred(x, centre)
            w = np.full((len(d), k), np.nan)
            w[:, sound] = projected(d, mean, scaled)
            wide = d if narrow or d.dtype == object else d.astype(object)
            length, cross = (d * d).sum(axis=1).astype(object), (wide * np.array(rest, dtype=wide.dtype)).sum(axis=1).astype(object)
            exact = [int(v) for v in length * (n * n) - cross * (2 * n) + square_rest]  # sum of (n d - r)^2
            rows = np.repeat(np.arange(len(d)), k)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(d))), pa.array(np.full(len(rows), n, dtype=np.int64)),
                pa.array([v if v <= LONG[1] else None for v in exact], pa.int64()).take(pa.array(rows)), pa.array(w.ravel(), mask=np.tile(~sound, len(d))),
                pa.array(explained * len(d), pa.float64()), pa.array(list(map(str, exact)), pa.string()).take(pa.array(rows))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "deviation_digits"])

    return vectors.mapInArrow(work, ROW).withColumn("identity_error", F.lit(error))


@query("op12_whitening")
def op12(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))
