"""Page fits of routes of few spans equal the written rounds and need no rounds of their own."""
import random

import pytest

from routekit.operators import placement


def tables(spark, missing=False):
    rng = random.Random(3)
    pages, poles, spans = [], [], []
    for route in range(1, 9):
        for page in range(1, 2 + route % 4):
            pages.append((route, page, 150.0 * page + rng.uniform(-20, 20), rng.uniform(-20, 20), 0.5, 0.5, rng.uniform(-0.1, 0.1)))
            poles += [(route, 4 * page + k, page, 60.0 * k, 300.0 + rng.uniform(-9, 9)) for k in range(4)]
        spans += [(route, n, n + 1, rng.uniform(25, 40), None) for n in range(4, 7 + 4 * (route % 4))]
    if missing:
        poles[5] = (*poles[5][:3], None, 300.0)
    return (spark.createDataFrame(pages, "route_id long, page int, origin_e double, origin_n double, sx double, sy double, theta double"),
            spark.createDataFrame(poles, "route_id long, number int, page int, x double, y double"),
            spark.createDataFrame(spans, "route_id long, lo int, hi int, meters double, source string"),
            spark.createDataFrame([(route, 1) for route in range(1, 9) if route != 6], "route_id long, page int"))


@pytest.mark.parametrize("missing", [False, True])
def test_small_routes_equal_the_rounds(spark, monkeypatch, missing):
    fit = lambda: {(r.route_id, r.page): r[2:] for r in placement.fit_page_origins(*tables(spark, missing), rounds=5).collect()}
    got = fit()
    monkeypatch.setattr(placement, "SMALL_OBS", 0)
    want = fit()
    assert set(got) == set(want) and len(got) == 20
    assert all(a == pytest.approx(b, abs=1e-6) for k in got for a, b in zip(got[k], want[k]))
    assert sum(r[4] < r[3] for r in got.values()) > 10


def test_small_routes_need_no_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(placement, "checkpoint", lambda df, f=placement.checkpoint: written.append(1) or f(df))
    assert placement.fit_page_origins(*tables(spark), rounds=20).count() == 20 and len(written) < 8
