"""Shared patterns against brute force, with chunks and cells small enough to cross borders."""
import math
import random

from pyspark.sql import functions as F

from routekit.operators import core


def test_ordered_scan_crosses_chunks(spark):
    rng = random.Random(1)
    rows = [(k, n, rng.choice([None, float(n)])) for k in (1, 2) for n in sorted(rng.sample(range(100), 40))]
    df = spark.createDataFrame(rows, "k int, n int, v double")
    got = {(r.k, r.n): r for r in core.ordered_scan(
        df, "k", "n", chunk=core.number_chunk("n", 7), lag={"a": "n"}, lead={"b": "v"}, cumsum={"c": "v"}, last={"d": "v"}, following={"e": "v"}, cummax={"f": "n"}).collect()}
    for k in (1, 2):
        seq = [r for r in rows if r[0] == k]
        for i, (_, n, v) in enumerate(seq):
            r = got[(k, n)]
            before, after = [x[2] for x in seq[:i] if x[2] is not None], [x[2] for x in seq[i + 1:] if x[2] is not None]
            assert r.a == (seq[i - 1][1] if i else None)
            assert r.b == (seq[i + 1][2] if i + 1 < len(seq) else None)
            upto = [x[2] for x in seq[:i + 1] if x[2] is not None]
            assert r.c == (sum(upto) if upto else None)
            assert r.d == (before[-1] if before else None) and r.e == (after[0] if after else None) and r.f == n


def test_rank_values(spark):
    rng = random.Random(2)
    rows = [(k, round(rng.random(), 2)) for k in range(3) for _ in range(37 + k)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r for r in core.rank_values(df, "k", "v", {"m": core.upper_median, "p": core.nearest_rank_95}, width=0.05).collect()}
    for k in range(3):
        vals = sorted(v for kk, v in rows if kk == k)
        assert (got[k].m, got[k].p) == (vals[len(vals) // 2], vals[math.ceil(len(vals) * 0.95) - 1])


def _points(spark, n, prefix, seed):
    rng = random.Random(seed)
    rows = [(1, i, rng.random() * 100, rng.random() * 100) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"g int, {prefix}id long, {prefix}x double, {prefix}y double")


def test_nearest_and_knn_equal_brute_force(spark):
    left, ldf = _points(spark, 40, "l", 3)
    right, rdf = _points(spark, 30, "r", 4)
    d = lambda a, b: math.hypot(a[2] - b[2], a[3] - b[3])
    got = {r.lid: r.rid for r in core.nearest(ldf, rdf, ["g"], start=1.0).collect()}
    assert got == {a[1]: min(right, key=lambda b: (d(a, b), b[1]))[1] for a in left}
    knn = {(r.lid, r["rank"]): r.rid for r in core.knn(ldf, rdf, 3, ["g"], start=1.0).collect()}
    for a in left:
        want = sorted(right, key=lambda b: (d(a, b), b[1]))[:3]
        assert [knn[(a[1], i + 1)] for i in range(3)] == [b[1] for b in want]


def test_assignment_equals_greedy_also_in_bands(spark):
    rng = random.Random(5)
    left = [(1, i, float(rng.randrange(8)), float(rng.randrange(8))) for i in range(60)]
    right = [(1, i, float(rng.randrange(8)), float(rng.randrange(8))) for i in range(50)]
    pairs = sorted((math.hypot(a[2] - b[2], a[3] - b[3]), a[1], b[1]) for a in left for b in right if math.hypot(a[2] - b[2], a[3] - b[3]) <= 3)
    used_l, used_r, want = set(), set(), set()
    for _, a, b in pairs:
        if a not in used_l and b not in used_r:
            used_l.add(a), used_r.add(b), want.add((a, b))
    ldf = spark.createDataFrame(left, "g int, lid long, lx double, ly double")
    rdf = spark.createDataFrame(right, "g int, rid long, rx double, ry double")
    for dense in (10 ** 6, 20):
        got = {(r.lid, r.rid) for r in core.assign_1to1(ldf, rdf, ["g"], max_d=3.0, dense=dense).collect()}
        assert got == want


def test_chunked_fold_hands_state_on(spark):
    rows = [(k, n, float(n % 5)) for k in (1, 2) for n in range(1, 24 * k)]
    df = spark.createDataFrame(rows, "k int, n int, v double")
    out = core.chunked_fold(df, "k", "n", fields=["v"], zero=F.lit(0.0), width=5, step=lambda s, r: s * 0.5 + r["v"], emit=lambda s, r: F.struct(r["n"].alias("n"), s.alias("s")))
    got = {(r.k, r.n): r.s for r in out.collect()}
    for k in (1, 2):
        state = 0.0
        for _, n, v in [r for r in rows if r[0] == k]:
            state = state * 0.5 + v
            assert got[(k, n)] == state


def test_a_dense_table_is_not_broadcast_for_its_small_file(spark):
    from routekit.plans.views import Views
    Views(spark, "/root/testdata/sf0.001")
    dense = core.checkpoint(spark.range(4_000_000).selectExpr("id div 64 AS route_id", "id % 64 AS lo"))
    joined = spark.range(4_000_000).selectExpr("id AS route_id", "0L AS lo").join(dense, ["route_id", "lo"], "left")
    assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_a_row_is_offered_to_few_cells_and_no_pair_is_lost(spark):
    rng = random.Random(5)
    spots = [(i, rng.choice([rng.uniform(-9, 9), float(rng.randrange(-9, 9))]), float(rng.randrange(-9, 9))) for i in range(150)]
    left, right = spark.createDataFrame(spots, "lid int, lx double, ly double"), spark.createDataFrame(spots, "rid int, rx double, ry double")
    for radius in (1.0, 2.5):
        assert core.cells(right, ["rx", "ry"], radius, halo=True).count() < 7 * len(spots)
        got = {(r.lid, r.rid) for r in core.radius_pairs(left, right, radius).collect()}
        assert got == {(i, j) for i, a, b in spots for j, c, d in spots if math.sqrt((c - a) * (c - a) + (d - b) * (d - b)) <= radius}
