"""Groups that are settled in one go give the same pairs as the rounds, and rings read their inputs once."""
import math
import random

import pytest

from routekit.operators import core


def greedy(pairs):
    lefts, rights, out = set(), set(), set()
    for cost, g, l, r in sorted(pairs):
        if (g, l) not in lefts and (g, r) not in rights:
            lefts.add((g, l))
            rights.add((g, r))
            out.add((g, l, r, cost))
    return out


@pytest.mark.parametrize("small", [30, 1024])
def test_small_groups_equal_the_rounds(spark, monkeypatch, small):
    monkeypatch.setattr(core, "SMALL", small)
    rng = random.Random(5)
    place = lambda g, k: (g, k, float(rng.randrange(12)), float(rng.randrange(12)))
    left = [place(g, k) for g in range(6) for k in range(2 + 2 * g)] + [(9, 1, None, 0.0), (8, 1, 0.0, 0.0)]
    right = [place(g, 100 + k) for g in range(6) for k in range(1 + 2 * g)]
    want = greedy([(math.hypot(c - x, d - y), g, l, r) for g, l, x, y in left for h, r, c, d in right if g == h and x is not None and math.hypot(c - x, d - y) <= 5])
    lefts = spark.createDataFrame(left, "g int, lid long, lx double, ly double")
    rights = spark.createDataFrame(right, "g int, rid long, rx double, ry double")
    got = {(r.g, r.lid, r.rid, r.d) for r in core.assign_1to1(lefts, rights, ["g"], max_d=5.0).collect()}
    assert got == want
    pairs = core.radius_pairs(lefts.where("lx IS NOT NULL"), rights, 5.0, ["g"]).selectExpr("g", "lid", "rid", "d AS cost", "concat(lid, '-', rid) AS note")
    got = core.greedy_pairs(pairs, ["g"]).collect()
    assert {(r.g, r.lid, r.rid, r.cost) for r in got} == want and all(r.note == f"{r.lid}-{r.rid}" for r in got)


def test_small_groups_need_no_cells(spark, monkeypatch):
    monkeypatch.setattr(core, "cells", lambda *a, **k: pytest.fail("a group of one pair was dealt to cells"))
    left = spark.createDataFrame([(g, 1, 0.0, 0.0) for g in range(4)], "g int, lid long, lx double, ly double")
    right = spark.createDataFrame([(g, 2, 3.0, 4.0) for g in range(4)], "g int, rid long, rx double, ry double")
    assert {(r.g, r.d) for r in core.assign_1to1(left, right, ["g"], max_d=9.0).collect()} == {(g, 5.0) for g in range(4)}


@pytest.mark.parametrize("small", [0, 2, 1024])
def test_rings_read_their_targets_once(spark, monkeypatch, small):
    monkeypatch.setattr(core, "SMALL", small)
    reads = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            reads.add(1)
            yield r

    left = spark.createDataFrame([(1, k, 0.0, 0.0) for k in range(3)] + [(2, 9, 0.0, 0.0)], "g int, lid long, lx double, ly double")
    right = spark.createDataFrame(spark.createDataFrame([(1, 10, 0.5, 0.0), (2, 11, 900.0, 0.0)], "g int, rid long, rx double, ry double").rdd.mapPartitions(seen), "g int, rid long, rx double, ry double")
    assert {(r.lid, r.rid) for r in core.nearest(left, right, ["g"], start=1.0).collect()} == {(0, 10), (1, 10), (2, 10), (9, 11)}
    assert reads.value == 2
