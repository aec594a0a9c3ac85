"""Bridges of small groups need no written rounds and equal those of the rounds and of brute force."""
import random

import pytest

from routekit.operators import graph
from routekit.sources import files


def brute(edges):
    out = set()
    for g, u, v in edges:
        rest, near = [(a, b) for h, a, b in edges if h == g and (a, b) != (u, v)], {u}
        while grown := {x for e in rest for x in e if near & set(e)} - near:
            near |= grown
        if v not in near:
            out.add((g, u, v))
    return out


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(2)
    return sorted({(g, *sorted(rng.sample(range(4 + 2 * g), 2))) for g in range(9) for _ in range(3 + 3 * g)})


@pytest.mark.parametrize("small", [12, 1024])
def test_bridges_of_small_groups(spark, monkeypatch, edges, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rows = spark.createDataFrame([(g, *random.Random(u).sample((u, v), 2)) for g, u, v in edges] + [(1, 3, 3)], "route_id int, u long, v long")
    want = brute(edges)
    assert {tuple(r) for r in graph.bridges(rows).collect()} == want and 0 < len(want) < len(edges)


def test_small_groups_need_no_rounds(spark, monkeypatch, edges):
    monkeypatch.setattr(graph, "spanning_forest", lambda *a, **k: pytest.fail("a small group went through written rounds"))
    assert graph.bridges(spark.createDataFrame(edges, "route_id int, u long, v long")).count() == len(brute(edges))


def test_a_long_chain_is_walked(spark):
    chain = spark.createDataFrame([(1, k, k + 1) for k in range(1000)], "route_id int, u long, v long")
    assert graph.bridges(chain).count() == 1000


def test_map_documents_are_read_back_whole(spark, tmp_path):
    rows = [(route, (k,), f"line {k}") for route in range(40) for k in range(3)]
    files.write_kml(spark.createDataFrame(rows, "route_id long, ord struct<k:int>, text string"), str(tmp_path / "kml"))
    before = spark.conf.get(files.LISTING)
    got = files.read_kml(spark, str(tmp_path / "kml")).collect()
    assert sorted((r.route_id, r.value) for r in got) == sorted((r, t) for r, _, t in rows) and spark.conf.get(files.LISTING) == before
