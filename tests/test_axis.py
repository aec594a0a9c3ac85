import math

import duckdb
import pytest

import __spark_entry__ as entry
from routekit.operators import fits, sequence


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_a_covariance_of_zero_does_not_turn_the_axis_round(spark, parts):
    points = [(1, 1, 89.0, 378.0), (1, 1, 102.0, 62.0), (1, 1, 115.0, 378.0)] * 3
    rows = spark.createDataFrame(points, "route_id int, page int, x double, y double").repartition(parts)
    assert fits.principal_axis(rows, ["route_id", "page"]).first().theta == math.pi / 2


def test_marks_on_a_border_of_bins_are_ordered_as_by_the_sql(spark):
    """Pairs on slopes of 3 to 4, 5 to 12 and the like, one of which stands exactly on a multiple of 10 along its axis."""
    points, page = [], 0
    for a, b, c in ((3, 4, 5), (4, 3, 5), (5, 12, 13), (12, 5, 13), (8, 15, 17), (15, 8, 17), (7, 24, 25), (20, 21, 29)):
        for x in range(3, 600):
            for y in range(8, 400, 8):
                if (a * x - b * y) % (10 * c) == 0:
                    page += 1
                    points += [(page, 1, 2, float(x), float(y)), (page, 2, 2, x + float(a), y - float(b))]
    rows = spark.createDataFrame(points, "route_id long, mark_id long, page int, x double, y double").repartition(4)
    entries = rows.where("false").selectExpr("route_id", "page", "x AS entry_x", "y AS entry_y")
    got = {(r.route_id, r.mark_id): r.number for r in sequence.route_order(rows, entries).collect()}
    con = duckdb.connect()
    con.register("v_markers", rows.toArrow())
    sql = entry.oracle_sql()["o2_route_order"]
    want = con.execute("WITH " + sql[sql.index("mk AS (SELECT"):]).fetchall()
    assert page > 1000 and got == {(r, m): n for r, m, n in want}


def test_keys_without_a_place_have_no_axis(spark):
    rows = spark.createDataFrame([(1, 1, None, 2.0), (2, 1, 3.0, 4.0)], "route_id int, page int, x double, y double")
    assert {r.route_id: r.theta for r in fits.principal_axis(rows, ["route_id", "page"]).collect()} == {1: None, 2: 0.0}
