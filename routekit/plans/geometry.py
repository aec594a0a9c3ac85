"""Linework, grid and fit operators over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from routekit.operators import filters as fl
from routekit.operators import fits as ft
from routekit.operators import linework as lw
from routekit.plans.registry import query, r6, rounded
from routekit.plans.scalars import utm_fwd_ctes

FLAT = """po AS (SELECT *, last_value(CASE WHEN op = 'M' THEN x END IGNORE NULLS) OVER w AS sx, last_value(CASE WHEN op = 'M' THEN y END IGNORE NULLS) OVER w AS sy FROM v_path_ops
   WINDOW w AS (PARTITION BY route_id, page, path_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 pp AS (SELECT *, CASE WHEN op = 'Z' THEN sx ELSE x END AS ex, CASE WHEN op = 'Z' THEN sy ELSE y END AS ey FROM po),
 pl AS (SELECT *, lag(ex) OVER (PARTITION BY route_id, page, path_id ORDER BY seq) AS qx, lag(ey) OVER (PARTITION BY route_id, page, path_id ORDER BY seq) AS qy,
   CASE op WHEN 'C' THEN 10 WHEN 'Q' THEN 8 WHEN 'M' THEN 0 ELSE 1 END AS nn FROM pp),
 pk AS (SELECT *, unnest(range(0, nn + 1)) AS k FROM pl WHERE nn > 0 AND qx IS NOT NULL),
 pt AS (SELECT *, CAST(k AS DOUBLE) / nn AS t FROM pk),
 pv AS (SELECT route_id, page, path_id, seq, k,
   CASE op WHEN 'C' THEN pow(1-t,3)*qx + 3*pow(1-t,2)*t*x1 + 3*(1-t)*t*t*x2 + pow(t,3)*ex WHEN 'Q' THEN pow(1-t,2)*qx + 2*(1-t)*t*x1 + t*t*ex ELSE qx + t*(ex-qx) END AS bx,
   CASE op WHEN 'C' THEN pow(1-t,3)*qy + 3*pow(1-t,2)*t*y1 + 3*(1-t)*t*t*y2 + pow(t,3)*ey WHEN 'Q' THEN pow(1-t,2)*qy + 2*(1-t)*t*y1 + t*t*ey ELSE qy + t*(ey-qy) END AS by_ FROM pt),
 fl AS (SELECT route_id, page, path_id, seq, k, ax, ay, bx, by_ FROM (SELECT *, lag(bx) OVER (PARTITION BY route_id, page, path_id, seq ORDER BY k) AS ax,
   lag(by_) OVER (PARTITION BY route_id, page, path_id, seq ORDER BY k) AS ay FROM pv) WHERE k > 0)"""
ARC = """sl AS (SELECT *, "by" AS by_, sqrt(pow(bx - ax, 2) + pow("by" - ay, 2)) AS len FROM v_segs),
 sg AS (SELECT *, sum(len) OVER (PARTITION BY route_id, page, path_id ORDER BY seq) - len AS cum0 FROM sl)"""


def hits_sql(points: str, name: str = "hit", far: str = "") -> str:
    """CTEs name(route_id, page, point_id, d, path_id, x, y, t) for points(route_id, page, point_id, x, y)."""
    return f"""{name}0 AS (SELECT p.route_id, p.page, p.point_id, p.x AS px, p.y AS py, s.*  EXCLUDE (route_id, page),
   greatest(0, least(1, ((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay)) / (len * len))) AS f FROM ({points}) p JOIN sg s ON s.route_id = p.route_id AND s.page = p.page),
 {name}1 AS (SELECT *, sqrt(pow(px - ax - f * (bx - ax), 2) + pow(py - ay - f * (by_ - ay), 2)) AS d FROM {name}0),
 {name} AS MATERIALIZED (SELECT route_id, page, point_id, d, path_id, ax + f * (bx - ax) AS x, ay + f * (by_ - ay) AS y, cum0 + f * len AS t FROM
   (SELECT *, row_number() OVER (PARTITION BY route_id, page, point_id ORDER BY d, path_id, seq) AS rk FROM {name}1) WHERE rk = 1)"""


POLE_POINTS = "SELECT route_id, page, number AS point_id, x, y FROM v_tracks"
HITS = f"{ARC}, {hits_sql(POLE_POINTS)}"


def arcs(v):
    return lw.with_arc(v.segs)


def hits(v, points=None):
    points = v.tracks if points is None else points
    found = lw.nearest_on_cable(points.selectExpr("route_id", "page", "number AS point_id", "x", "y"), arcs(v))
    return found.withColumnRenamed("point_id", "number")


@query("p27_flatten_curves", f"WITH {FLAT} SELECT route_id, page, seq, k, round(ax, 5) AS ax, round(ay, 5) AS ay, round(bx, 5) AS bx, round(by_, 5) AS by_ FROM fl")
def _(v):
    return rounded(lw.flatten_curves(v.path_ops).withColumnRenamed("by", "by_"), "ax", "ay", "bx", "by_", places=5).drop("path_id")


@query("w8_route_position", f"WITH {ARC} SELECT route_id, page, seq, round(len, 6) AS len, round(cum0, 6) AS cum0 FROM sg")
def _(v):
    return rounded(arcs(v).select("route_id", "page", "seq", "len", "cum0"), "len", "cum0")


@query("s12_cable_table", """SELECT route_id, page, path_id, arg_min(x, seq) FILTER (op IN ('M', 'L')) AS sx, arg_min(y, seq) FILTER (op IN ('M', 'L')) AS sy, arg_max(x, seq) FILTER (op IN ('M', 'L')) AS ex,
 arg_max(y, seq) FILTER (op IN ('M', 'L')) AS ey, count(*) AS n_ops FROM v_path_ops GROUP BY ALL""")
def _(v):
    return lw.cable_table(v.path_ops).selectExpr("route_id", "page", "path_id", "start.x AS sx", "start.y AS sy", "end.x AS ex", "end.y AS ey", "n_ops")


@query("a22_path_stats", f"""WITH {FLAT}, n AS (SELECT route_id, page, path_id, count(*) FILTER (op = 'M') AS subpaths FROM v_path_ops GROUP BY ALL),
 l AS (SELECT route_id, page, path_id, sum(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2))) AS length FROM fl GROUP BY ALL)
 SELECT route_id, page, path_id, subpaths, round(coalesce(length, 0), 5) AS length, subpaths >= 5 AS fragmented FROM n LEFT JOIN l USING (route_id, page, path_id)""")
def _(v):
    return rounded(lw.path_stats(v.path_ops), "length", places=5)


@query("j4_nearest_on_cable", f"WITH {HITS} SELECT route_id, page, point_id, path_id, round(d, 6) AS d, round(x, 6) AS x, round(y, 6) AS y, round(t, 6) AS t FROM hit")
def _(v):
    return rounded(hits(v).withColumnRenamed("number", "point_id"), "d", "x", "y", "t")


@query("f14_far_from_cable", f"WITH {ARC}, {hits_sql('SELECT route_id, page, sym_id AS point_id, x, y + CASE WHEN sym_id % 5 = 0 THEN 60 ELSE 0 END AS y FROM v_symbols')} SELECT route_id, page, point_id, round(d, 6) AS d FROM hit WHERE d > 50")
def _(v):
    points = v.symbols.selectExpr("route_id", "page", "sym_id AS point_id", "x", "y + CASE WHEN sym_id % 5 = 0 THEN 60 ELSE 0 END AS y")
    return rounded(fl.far_from_cable(lw.nearest_on_cable(points, arcs(v))).select("route_id", "page", "point_id", "d"), "d")


@query("q8_point_at_arc", f"""WITH {ARC}, tt AS (SELECT route_id, page, CAST(page - 1 AS BIGINT) AS path_id, number, v * 6 AS t FROM v_tracks), tot AS (SELECT route_id, page, path_id, max(cum0 + len) AS total FROM sg GROUP BY ALL),
 c AS (SELECT tt.*, least(t, total) AS tc FROM tt JOIN tot USING (route_id, page, path_id)),
 m AS (SELECT c.route_id, c.number, ax + (tc - cum0) / len * (bx - ax) AS px, ay + (tc - cum0) / len * (by_ - ay) AS py, row_number() OVER (PARTITION BY c.route_id, c.number ORDER BY seq) AS k FROM c JOIN sg s ON s.route_id = c.route_id AND s.page = c.page AND s.path_id = c.path_id AND tc <= cum0 + len)
 SELECT route_id, number, round(px, 6) AS px, round(py, 6) AS py FROM m WHERE k = 1""")
def _(v):
    targets = v.tracks.selectExpr("route_id", "page", "CAST(page - 1 AS BIGINT) AS path_id", "number AS target_id", "v * 6 AS t")
    return rounded(lw.point_at_arc(arcs(v), targets).selectExpr("route_id", "target_id AS number", "px", "py"), "px", "py")


TANGENT = """tb AS (SELECT q.*, greatest(0, least(total, t)) AS t0, greatest(0, least(total, greatest(0, least(total, t)) + dir * 3)) AS t1 FROM {src} q JOIN tot USING (route_id, page, path_id)),
 te AS (SELECT tb.route_id, tb.page, tb.number, s.seq, ax + (t0 - cum0) / len * (bx - ax) AS x0, ay + (t0 - cum0) / len * (by_ - ay) AS y0, row_number() OVER (PARTITION BY tb.route_id, tb.page, tb.number ORDER BY seq) AS k FROM tb JOIN sg s ON s.route_id = tb.route_id AND s.page = tb.page AND s.path_id = tb.path_id AND t0 <= cum0 + len),
 tf AS (SELECT tb.route_id, tb.page, tb.number, s.seq, ax + (t1 - cum0) / len * (bx - ax) AS x1, ay + (t1 - cum0) / len * (by_ - ay) AS y1, row_number() OVER (PARTITION BY tb.route_id, tb.page, tb.number ORDER BY seq) AS k FROM tb JOIN sg s ON s.route_id = tb.route_id AND s.page = tb.page AND s.path_id = tb.path_id AND t1 <= cum0 + len),
 tg AS (SELECT te.route_id, te.page, te.number, (degrees(atan2(x1 - x0, y0 - y1)) + 360) % 360 AS bearing FROM te JOIN tf USING (route_id, page, number) WHERE te.k = 1 AND tf.k = 1)"""
TOT = "tot AS (SELECT route_id, page, path_id, max(cum0 + len) AS total FROM sg GROUP BY ALL)"


@query("w22_cable_between", f"""WITH {HITS}, {TOT}, pr AS (SELECT a.route_id, a.page, a.path_id, a.point_id AS number, abs(b.t - a.t) AS arc_pt, (a.t + b.t) / 2 AS t, CASE WHEN b.t >= a.t THEN 1 ELSE -1 END AS dir
   FROM hit a JOIN hit b ON a.route_id = b.route_id AND a.page = b.page AND a.path_id = b.path_id AND b.point_id = a.point_id + 1 WHERE a.d <= 80 AND b.d <= 80), {TANGENT.format(src='pr')}
 SELECT pr.route_id, pr.page, pr.number, round(arc_pt, 6) AS arc_pt, round(bearing, 5) AS bearing FROM pr JOIN tg USING (route_id, page, number)""")
def _(v):
    out = lw.cable_between(hits(v), arcs(v))
    return out.select("route_id", "page", "number", r6("arc_pt").alias("arc_pt"), r6("bearing", 5).alias("bearing"))


@query("w22_exit_bearings", f"""WITH {HITS}, {TOT}, lp AS (SELECT *, row_number() OVER (PARTITION BY route_id, page ORDER BY point_id DESC) AS k FROM hit),
 ex AS (SELECT route_id, page, path_id, point_id AS number, t, CASE WHEN t >= total * 0.5e0 THEN 1 ELSE -1 END AS dir FROM lp JOIN tot USING (route_id, page, path_id) WHERE k = 1 AND d <= 80), {TANGENT.format(src='ex')}
 SELECT route_id, page, number, round(bearing, 5) AS bearing FROM tg""")
def _(v):
    return rounded(lw.exit_bearings(hits(v), arcs(v)).drop("path_id"), "bearing", places=5)


TAPPED = "SELECT route_id, page, number, CASE WHEN source = 'purchase' THEN x + 140 ELSE x END AS x, y FROM v_tracks"


def tapped(v):
    return v.tracks.withColumn("x", F.when(F.col("source") == "purchase", F.col("x") + 140).otherwise(F.col("x")))


@query("w17_tap_poles", f"""WITH {ARC}, {hits_sql(f'SELECT route_id, page, number AS point_id, x, y FROM ({TAPPED})')}
 SELECT h.route_id, h.point_id AS number, coalesce(h.d <= 30 AND (h.t < least(p.t, n.t) - 20 OR h.t > greatest(p.t, n.t) + 20), false) AND p.t IS NOT NULL AND n.t IS NOT NULL AS is_tap FROM hit h
 LEFT JOIN hit p ON p.route_id = h.route_id AND p.page = h.page AND p.path_id = h.path_id AND p.point_id = h.point_id - 1 LEFT JOIN hit n ON n.route_id = h.route_id AND n.page = h.page AND n.path_id = h.path_id AND n.point_id = h.point_id + 1""")
def _(v):
    return lw.tap_poles(hits(v, tapped(v))).select("route_id", "number", "is_tap")


REV = "SELECT route_id, page, CASE WHEN route_id % 2 = 0 THEN 65 - number ELSE number END AS point_id, x, y FROM v_tracks"


@query("w18_arc_direction", f"""WITH {ARC}, {hits_sql('SELECT route_id, CASE WHEN route_id % 2 = 0 THEN 5 - page ELSE page END AS pg, page, CASE WHEN route_id % 2 = 0 THEN 65 - number ELSE number END AS point_id, x, y FROM v_tracks')},
 ch AS (SELECT route_id, page, sum(30e0) * 2 AS chain_pt FROM v_tracks GROUP BY ALL),
 e AS (SELECT route_id, page, regr_slope(t, point_id) AS s, arg_min(t, point_id) AS t0, arg_max(t, point_id) AS t1 FROM hit GROUP BY ALL)
 SELECT route_id, page, CASE WHEN s < 0 THEN -1 ELSE 1 END AS slope_dir, CASE WHEN abs(t0 - chain_pt - t1) + 8 < abs(t0 + chain_pt - t1) THEN -1 WHEN abs(t0 + chain_pt - t1) + 8 < abs(t0 - chain_pt - t1) THEN 1 WHEN s < 0 THEN -1 ELSE 1 END AS chain_dir FROM e JOIN ch USING (route_id, page)""")
def _(v):
    mirrored = v.tracks.withColumn("number", F.when(F.col("route_id") % 2 == 0, 65 - F.col("number")).otherwise(F.col("number")))
    found = hits(v, mirrored)
    chain = v.tracks.groupBy("route_id", "page").agg((F.count("*") * 60.0).alias("chain_pt"))
    return (lw.arc_direction(found).withColumnRenamed("direction", "slope_dir")
            .join(lw.arc_direction(found, chain).withColumnRenamed("direction", "chain_dir"), ["route_id", "page"]))


@query("o6_pick_route_cable", f"""WITH {ARC.replace('FROM v_segs)', "FROM (SELECT * REPLACE (path_id * 3 + seq % 3 AS path_id) FROM v_segs))")}, rf AS (SELECT route_id, page, arg_min(x, number) AS x, arg_min(y, number) AS y FROM v_tracks GROUP BY ALL),
 h AS (SELECT s.*, r.x AS px, r.y AS py, greatest(0, least(1, ((r.x - ax) * (bx - ax) + (r.y - ay) * (by_ - ay)) / (len * len))) AS f FROM rf r JOIN sg s USING (route_id, page)),
 g AS (SELECT *, sqrt(pow(px - ax - f * (bx - ax), 2) + pow(py - ay - f * (by_ - ay), 2)) AS d, cum0 + f * len AS t FROM h),
 b AS (SELECT route_id, page, path_id, d, t, row_number() OVER (PARTITION BY route_id, page, path_id ORDER BY d, t) AS k FROM g)
 SELECT route_id, page, path_id, round(d, 6) AS d, round(t, 6) AS t FROM (SELECT *, row_number() OVER (PARTITION BY route_id, page ORDER BY t - 2 * d DESC, path_id) AS z FROM b WHERE k = 1 AND d <= 80) WHERE z = 1""")
def _(v):
    segs = v.segs.withColumn("path_id", F.col("path_id") * 3 + F.col("seq") % 3)
    ref = v.tracks.groupBy("route_id", "page").agg(F.min_by("x", "number").alias("x"), F.min_by("y", "number").alias("y"))
    return rounded(lw.pick_route_cable(ref, lw.with_arc(segs)), "d", "t")


@query("j16_touching_segments", """WITH c AS (SELECT route_id, CAST(number AS BIGINT) AS path_id, number, x, y FROM v_tracks), e AS (SELECT c.route_id, c.path_id, c.x, c.y FROM c UNION ALL SELECT route_id, path_id, x + 55 + (number % 4) * 3, y + (number % 3) * 4 FROM c)
 SELECT DISTINCT a.route_id, a.path_id AS path_a, b.path_id AS path_b FROM e a JOIN e b ON a.route_id = b.route_id AND a.path_id < b.path_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 5""")
def _(v):
    cables = v.tracks.select("route_id", F.col("number").cast("long").alias("path_id"), F.struct("x", "y").alias("start"),
                             F.struct((F.col("x") + 55 + (F.col("number") % 4) * 3).alias("x"), (F.col("y") + (F.col("number") % 3) * 4).alias("y")).alias("end"))
    return lw.touching_segments(cables, by=("route_id",))


LINES = """gl AS (SELECT route_id, page, seq, CASE WHEN abs("by" - ay) <= 2 AND abs(bx - ax) > abs("by" - ay) THEN 'h' WHEN abs(bx - ax) <= 2 AND abs("by" - ay) > abs(bx - ax) THEN 'v' END AS axis, ax, ay, bx, "by" AS by_ FROM v_grid WHERE sqrt(pow(bx - ax, 2) + pow("by" - ay, 2)) >= 2),
 li AS (SELECT route_id, page, seq, axis, CASE WHEN axis = 'h' THEN (ay + by_) / 2 ELSE (ax + bx) / 2 END AS pos FROM gl WHERE axis IS NOT NULL),
 ga AS (SELECT route_id, page, axis, pos - lag(pos) OVER (PARTITION BY route_id, page, axis ORDER BY pos) AS gap FROM (SELECT DISTINCT route_id, page, axis, pos FROM li)),
 sp AS (SELECT route_id, page, axis, median(gap) AS spacing FROM ga WHERE gap > 5 GROUP BY ALL)"""


@query("f15_grid_lines", f"WITH {LINES} SELECT route_id, page, seq, axis, round(pos, 6) AS pos FROM li")
def _(v):
    return lw.classify_grid_lines(v.grid).select("route_id", "page", "seq", "axis", r6("pos").alias("pos"))


@query("a4_grid_scale", f"WITH {LINES} SELECT route_id, page, round(avg(spacing), 6) AS spacing, round(50 / avg(spacing), 9) AS scale FROM sp GROUP BY ALL")
def _(v):
    return rounded(rounded(lw.grid_scale(lw.classify_grid_lines(v.grid)), "spacing"), "scale", places=9)


@query("d3_dedupe_positions", """WITH RECURSIVE p AS (SELECT DISTINCT page, round(x / 2, 0) * 0.7e0 AS pos FROM v_poles), k AS (SELECT page, min(pos) AS pos FROM p GROUP BY page UNION ALL
  SELECT k.page, (SELECT min(p.pos) FROM p WHERE p.page = k.page AND p.pos - k.pos > 2) FROM k WHERE k.pos IS NOT NULL) SELECT page, round(pos, 6) AS pos FROM k WHERE pos IS NOT NULL""")
def _(v):
    lines = v.poles.select("page", (F.round(F.col("x") / 2) * 0.7).alias("pos"))
    return rounded(lw.dedupe_positions(lines, "page"), "pos")


CTRL = f"""{LINES}, st AS (SELECT route_id, page, axis, count(*) AS n, min(pos) AS p0 FROM li GROUP BY ALL), rd AS (SELECT li.*, (pos - p0) / spacing * 50 AS rel FROM li JOIN st USING (route_id, page, axis) JOIN sp USING (route_id, page, axis) WHERE n >= 2),
 cp AS (SELECT a.route_id, a.page, a.pos AS x, b.pos AS y, a.rel AS e_rel, b.rel AS n_rel FROM rd a JOIN rd b ON a.route_id = b.route_id AND a.page = b.page AND a.axis = 'v' AND b.axis = 'h')"""


def controls(v):
    return lw.grid_control_points(lw.classify_grid_lines(v.grid))


@query("j22_grid_controls", f"WITH {CTRL} SELECT route_id, page, round(x, 6) AS x, round(y, 6) AS y, round(e_rel, 6) AS e_rel, round(n_rel, 6) AS n_rel FROM cp")
def _(v):
    return rounded(controls(v), "x", "y", "e_rel", "n_rel")


FIT = f"""{CTRL}, su AS (SELECT route_id, page, count(*) AS n, sum(x*x) AS xx, sum(-x*y) AS xp, sum(y*y) AS pp, sum(x*e_rel) AS xe, sum(-y*e_rel) AS pe, sum(x*n_rel) AS xn, sum(-y*n_rel) AS pn FROM cp GROUP BY ALL),
 ff AS (SELECT route_id, page, n, (xe*pp - pe*xp) / (xx*pp - xp*xp) AS m00, (pe*xx - xe*xp) / (xx*pp - xp*xp) AS m01, (xn*pp - pn*xp) / (xx*pp - xp*xp) AS m10, (pn*xx - xn*xp) / (xx*pp - xp*xp) AS m11 FROM su WHERE n >= 4)"""


@query("a7_affine_fit", f"WITH {FIT} SELECT route_id, page, n, round(m00, 6) AS m00, round(m01, 6) AS m01, round(m10, 6) AS m10, round(m11, 6) AS m11 FROM ff")
def _(v):
    return rounded(ft.affine_fit(controls(v)), "m00", "m01", "m10", "m11")


@query("a8_choose_by_rmse", f"""WITH {FIT}, f0 AS (SELECT route_id, page, min(x) AS fx, arg_min(y, [x, y]) AS fy FROM cp GROUP BY ALL),
 q AS (SELECT cp.*, sqrt(pow(m00*x - m01*y - e_rel, 2) + pow(m10*x - m11*y - n_rel, 2)) AS ea, sqrt(pow((x - fx) * 0.83e0 - e_rel, 2) + pow(-(y - fy) * 0.83e0 - n_rel, 2)) AS ep FROM cp JOIN ff USING (route_id, page) JOIN f0 USING (route_id, page)),
 z AS (SELECT route_id, page, sqrt(avg(ea*ea)) AS rmse_fit, max(ea) AS max_err, sqrt(avg(ep*ep)) AS rmse_prior FROM q GROUP BY ALL)
 SELECT route_id, page, round(rmse_fit, 5) AS rmse_fit, round(max_err, 5) AS max_err, round(rmse_prior, 5) AS rmse_prior, rmse_fit < rmse_prior AND max_err <= 2 AS use_fit FROM z""")
def _(v):
    points = controls(v)
    prior = v.tracks.select("route_id", "page").distinct().select("*", F.lit(0.83).alias("sx"), F.lit(0.83).alias("sy"), F.lit(0.0).alias("theta"))
    return rounded(ft.choose_by_rmse(points, ft.affine_fit(points), prior), "rmse_fit", "max_err", "rmse_prior", places=5)


@query("a6_dominant_orientation", """WITH q AS (SELECT route_id, page, bx - ax AS dx, ("by" + v2 - ay) AS dy FROM (SELECT *, page * 6e0 - 6 AS v2 FROM v_segs)), s AS (SELECT route_id, page, count(*) AS n, atan2(sum(dy), sum(dx)) AS th FROM q WHERE sqrt(dx*dx + dy*dy) >= 2 AND abs(dx) >= 0.35e0 * abs(dy) GROUP BY ALL)
 SELECT route_id, page, round(CASE WHEN n >= 10 AND abs(degrees(th)) >= 1 THEN th ELSE 0 END, 9) AS theta FROM s""")
def _(v):
    segs = v.segs.withColumn("by", F.col("by") + F.col("page") * 6.0 - 6)
    return rounded(lw.dominant_orientation(segs), "theta", places=9)


@query("a5_label_scale", """SELECT s.route_id, round(sum(meters) / sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 9) AS scale FROM v_spans s JOIN v_tracks a ON a.route_id = s.route_id AND a.number = s.lo JOIN v_tracks b ON b.route_id = s.route_id AND b.number = s.hi
 WHERE meters > 0 AND a.page = b.page GROUP BY 1""")
def _(v):
    return rounded(ft.label_scale(v.tracks, v.spans), "scale", places=9)


DRAWN = """sm AS (SELECT s.route_id, a.page, meters / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS s FROM v_spans s JOIN v_tracks a ON a.route_id = s.route_id AND a.number = s.lo JOIN v_tracks b ON b.route_id = s.route_id AND b.number = s.hi
   WHERE meters > 0 AND a.page = b.page AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) > 5),
 dm AS (SELECT route_id, page, median(s) AS ms FROM sm GROUP BY ALL HAVING count(*) >= 3), dr AS (SELECT route_id, median(s) AS mr FROM sm GROUP BY 1 HAVING count(*) >= 3),
 ds AS (SELECT t.route_id, t.page, coalesce(ms, mr) AS scale FROM (SELECT DISTINCT route_id, page FROM v_tracks) t JOIN dr USING (route_id) LEFT JOIN dm USING (route_id, page))"""


@query("a14_drawn_scale", f"WITH {DRAWN} SELECT route_id, page, round(scale, 9) AS scale FROM ds")
def _(v):
    return rounded(ft.drawn_scale(v.tracks, v.spans), "scale", places=9)


SIMI = """sp AS (SELECT route_id, page, e AS px, n AS py, 1.01e0 * e - 0.02e0 * n + v / 50 AS qx, 0.02e0 * e + 1.01e0 * n - v / 90 AS qy FROM v_tracks),
 sc AS (SELECT route_id, page, count(*) AS n, avg(px) AS mpx, avg(py) AS mpy, avg(qx) AS mqx, avg(qy) AS mqy, covar_pop(qx, px) + covar_pop(qy, py) AS a, covar_pop(qx, py) - covar_pop(qy, px) AS b, var_pop(px) + var_pop(py) AS v FROM sp GROUP BY ALL)"""


@query("a9_similarity_fit", f"WITH {SIMI} SELECT route_id, page, n, round(sqrt(a*a + b*b) / v, 6) AS scale, round(atan2(b, a), 6) AS theta FROM sc WHERE n >= 2")
def _(v):
    pairs = v.tracks.selectExpr("route_id", "page", "e AS px", "n AS py", "1.01e0 * e - 0.02e0 * n + v / 50 AS qx", "0.02e0 * e + 1.01e0 * n - v / 90 AS qy")
    return rounded(ft.similarity_fit(pairs, ["route_id", "page"]).drop("tx", "ty"), "scale", "theta")


@query("a10_regression_bearing", """WITH q AS (SELECT *, row_number() OVER (PARTITION BY route_id, page ORDER BY number) AS i FROM v_tracks) SELECT route_id, page, count(*) AS n,
 CASE WHEN count(*) >= 3 THEN round((degrees(atan2(regr_slope(x, i), -regr_slope(y, i))) + 360) % 360, 5) END AS bearing FROM q GROUP BY ALL""")
def _(v):
    return rounded(ft.regression_bearing(v.tracks, ["route_id", "page"]), "bearing", places=5)


@query("a11_principal_axis", "SELECT route_id, page, round(0.5e0 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 6) AS theta FROM v_tracks GROUP BY ALL")
def _(v):
    return rounded(ft.principal_axis(v.tracks, ["route_id", "page"]).select("route_id", "page", "theta"), "theta")


@query("q5_page_transforms", f"""WITH an AS (SELECT route_id, page AS ap, x, y, lat, lon, 1.8e0 AS os FROM v_tracks WHERE number = 1), {utm_fwd_ctes('an')},
 bx AS (SELECT DISTINCT route_id, page, page * 150e0 AS vx, 40 + page * 7e0 AS vy, 140e0 AS vw, 900e0 AS pw, CASE WHEN page = 2 THEN NULL ELSE 0.4e0 + page * 0.05e0 END AS gs, CASE WHEN page = 3 THEN 0.1e0 WHEN page = 1 THEN 0.05e0 END AS th FROM v_tracks),
 st AS (SELECT u.*, b.vx AS avx, b.vy AS avy, coalesce(th, 0) AS ath, coalesce(gs, vw / pw * os) AS s FROM u JOIN bx b ON b.route_id = u.route_id AND b.page = ap),
 o AS (SELECT route_id, zone, os, avx, avy, ath, easting - (cos(ath) * x + sin(ath) * y) * s AS oe, northing + (cos(ath) * y - sin(ath) * x) * s AS orn FROM st)
 SELECT b.route_id, b.page, round(oe + (vx - avx) * os, 4) AS origin_e, round(orn - (vy - avy) * os, 4) AS origin_n, round(coalesce(gs, vw / pw * os), 9) AS sx, CASE WHEN coalesce(th, 0) <> 0 THEN th ELSE ath END AS theta, zone FROM bx b JOIN o USING (route_id)""")
def _(v):
    page = v.tracks.select("route_id", "page").distinct()
    viewports = page.selectExpr("route_id", "page", "page * 150e0 AS vx", "40 + page * 7e0 AS vy", "140e0 AS vw", "60e0 AS vh")
    pages = page.selectExpr("route_id", "page", "900e0 AS page_w", "CASE WHEN page = 3 THEN 0.1e0 WHEN page = 1 THEN 0.05e0 END AS theta",
                            "CASE WHEN page = 2 THEN NULL ELSE 0.4e0 + page * 0.05e0 END AS grid_scale")
    anchors = v.tracks.where("number = 1").selectExpr("route_id", "page", "x", "y", "lat", "lon", "1.8e0 AS overview_scale")
    out = ft.page_transforms(viewports, pages, anchors)
    return out.select("route_id", "page", r6("origin_e", 4).alias("origin_e"), r6("origin_n", 4).alias("origin_n"), r6("sx", 9).alias("sx"), "theta", "zone")


@query("q6_two_point_refit")
def _(v):
    wide = F.when(F.col("route_id") % 3 == 0, 0.2).otherwise(0.01)
    anchors = (v.tracks.where("number IN (1, 60)").withColumns({"ae": F.col("e") - (F.col("n") - 6900000) * wide, "an": F.col("n") + F.lit(3.0)})
               .select("route_id", "number", "ae", "an"))
    return ft.two_point_refit(v.tracks.select("route_id", "number", "e", "n"), anchors, v.spans)


POLY = "SELECT route_id, page AS path_id, number AS seq, x, y + CASE WHEN source = 'error' THEN 40 ELSE 0 END AS y FROM v_tracks"


def polyline(v):
    return v.tracks.selectExpr("route_id", "page AS path_id", "number AS seq", "x", "y + CASE WHEN source = 'error' THEN 40 ELSE 0 END AS y")


@query("w15_kinks", f"""WITH q AS ({POLY}), l AS (SELECT *, x - lag(x) OVER w AS ix, y - lag(y) OVER w AS iy, lead(x) OVER w - x AS ox, lead(y) OVER w - y AS oy FROM q WINDOW w AS (PARTITION BY route_id, path_id ORDER BY seq)),
 k AS (SELECT *, sum(coalesce(sqrt(ix*ix + iy*iy), 0)) OVER (PARTITION BY route_id, path_id ORDER BY seq) AS arc, degrees(acos(greatest(-1, least(1, (ix*ox + iy*oy) / (sqrt(ix*ix + iy*iy) * sqrt(ox*ox + oy*oy)))))) AS td FROM l)
 SELECT route_id, path_id, seq, round(arc, 6) AS arc, round(td, 6) AS turn_deg FROM k WHERE td >= 20""")
def _(v):
    return rounded(lw.kinks(polyline(v)).select("route_id", "path_id", "seq", "arc", "turn_deg"), "arc", "turn_deg")


@query("w16_dedupe_vertices")
def _(v):
    stroke = v.tracks.selectExpr("route_id", "page AS path_id", "number AS seq", "(number % 5) * 0.6e0 + number * 0.2e0 AS x", "(number % 3) * 0.5e0 AS y")
    return rounded(lw.dedupe_vertices(stroke, tol=1.0), "x", "y")


@query("q10_stitch_dashes", """WITH c AS (SELECT *, sum(CASE WHEN op = 'M' THEN 1 ELSE 0 END) OVER w AS dash, lag(x) OVER w AS qx, lag(y) OVER w AS qy FROM v_path_ops WINDOW w AS (PARTITION BY route_id, page, path_id ORDER BY seq)),
 b AS (SELECT route_id, page, path_id FROM c GROUP BY ALL HAVING max(dash) >= 5),
 m AS (SELECT route_id, page, path_id, dash, arg_max((x + qx) / 2, [sqrt(pow(x - qx, 2) + pow(y - qy, 2)), -seq]) FILTER (op = 'L') AS lx, arg_max((y + qy) / 2, [sqrt(pow(x - qx, 2) + pow(y - qy, 2)), -seq]) FILTER (op = 'L') AS ly,
   arg_min(x, seq) FILTER (op IN ('M', 'L')) AS fx, arg_min(y, seq) FILTER (op IN ('M', 'L')) AS fy FROM c JOIN b USING (route_id, page, path_id) GROUP BY ALL)
 SELECT route_id, page, dash, round(coalesce(lx, fx) * 0.6e0 + coalesce(ly, fy) * 0.8e0, 6) AS along, coalesce(lx, fx) AS x, coalesce(ly, fy) AS y FROM m""")
def _(v):
    axis = v.tracks.select("route_id", "page").distinct().selectExpr("*", "0e0 AS ref_x", "0e0 AS ref_y", "0.6e0 AS ux", "0.8e0 AS uy")
    return rounded(lw.stitch_dashes(v.path_ops, axis).drop("path_id"), "along")
