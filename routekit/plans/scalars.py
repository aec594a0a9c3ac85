"""Scalar functions and filters over whole tables."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from routekit.functions import *  # noqa: F403
from routekit.operators import filters as fl
from routekit.plans.registry import query, r6, rounded

PI180 = repr(math.pi / 180)


def hav_sql(a, b, c, d):
    h = (f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * "
         f"sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))")
    return f"(6371000e0 * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


def utm_fwd_ctes(source: str) -> str:
    """CTE chain u(…, easting, northing, zone) over a relation with lat, lon."""
    return f"""
u0 AS (SELECT *, CAST(floor((lon + 180) / 6) AS BIGINT) + 1 AS zone, 6378137e0 AS a, 1 - pow(1 - 1 / 298.257223563e0, 2) AS e2,
  radians(lat) AS phi FROM {source}),
u1 AS (SELECT *, e2 / (1 - e2) AS ep, a / sqrt(1 - e2 * pow(sin(phi), 2)) AS nn, pow(tan(phi), 2) AS t,
  e2 / (1 - e2) * pow(cos(phi), 2) AS c, cos(phi) * (radians(lon) - radians((zone - 1) * 6 - 177)) AS aa FROM u0),
u2 AS (SELECT *, a * ((1 - e2/4 - 3*e2*e2/64 - 5*pow(e2,3)/256) * phi - (3*e2/8 + 3*e2*e2/32 + 45*pow(e2,3)/1024) * sin(2*phi)
  + (15*e2*e2/256 + 45*pow(e2,3)/1024) * sin(4*phi) - (35*pow(e2,3)/3072) * sin(6*phi)) AS m FROM u1),
u AS (SELECT * EXCLUDE (a, e2, phi, ep, nn, t, c, aa, m),
  500000 + 0.9996e0 * nn * (aa + (1 - t + c) * pow(aa,3)/6 + (5 - 18*t + t*t + 72*c - 58*ep) * pow(aa,5)/120) AS easting,
  10000000 + 0.9996e0 * (m + nn * tan(phi) * (aa*aa/2 + (5 - t + 9*c + 4*c*c) * pow(aa,4)/24
   + (61 - 58*t + t*t + 600*c - 330*ep) * pow(aa,6)/720)) AS northing FROM u2)"""


def utm_inv_ctes(source: str, e: str = "e", n: str = "n", zone: str = "22", out: str = "g") -> str:
    """CTE chain g(…, glat, glon) over a relation with metres."""
    return f"""
{out}0 AS (SELECT *, 6378137e0 AS a_, 1 - pow(1 - 1 / 298.257223563e0, 2) AS e2_, {e} - 500000 AS x_, ({n} - 10000000) / 0.9996e0 AS m1_,
  ({zone} - 1) * 6 - 177 AS l0_ FROM {source}),
{out}1 AS (SELECT *, (1 - sqrt(1 - e2_)) / (1 + sqrt(1 - e2_)) AS e1_, m1_ / (a_ * (1 - e2_/4 - 3*e2_*e2_/64 - 5*pow(e2_,3)/256)) AS mu_ FROM {out}0),
{out}2 AS (SELECT *, mu_ + (3*e1_/2 - 27*pow(e1_,3)/32) * sin(2*mu_) + (21*e1_*e1_/16 - 55*pow(e1_,4)/32) * sin(4*mu_)
  + (151*pow(e1_,3)/96) * sin(6*mu_) + (1097*pow(e1_,4)/512) * sin(8*mu_) AS f_ FROM {out}1),
{out}3 AS (SELECT *, e2_ / (1 - e2_) AS ep_, a_ / sqrt(1 - e2_ * pow(sin(f_), 2)) AS n1_, pow(tan(f_), 2) AS t1_,
  e2_ / (1 - e2_) * pow(cos(f_), 2) AS c1_, a_ * (1 - e2_) / pow(1 - e2_ * pow(sin(f_), 2), 1.5e0) AS r1_ FROM {out}2),
{out}4 AS (SELECT *, x_ / (n1_ * 0.9996e0) AS d_ FROM {out}3),
{out} AS (SELECT * EXCLUDE (a_, e2_, x_, m1_, e1_, mu_, f_, ep_, n1_, t1_, c1_, r1_, d_, l0_),
  degrees(f_ - (n1_ * tan(f_) / r1_) * (d_*d_/2 - (5 + 3*t1_ + 10*c1_ - 4*c1_*c1_ - 9*ep_) * pow(d_,4)/24)) AS glat,
  l0_ + degrees((d_ - (1 + 2*t1_ + c1_) * pow(d_,3)/6) / cos(f_)) AS glon FROM {out}4)"""


@query("p1_parse_metres", "SELECT route_id, item_id, CAST(replace(str, ',', '.') AS DOUBLE) AS metres FROM v_labels")
def _(v):
    return v.labels.select("route_id", "item_id", parse_metres("str").alias("metres"))


@query("p2_pole_type", r"""SELECT route_id, item_id, nullif(trim(regexp_replace(regexp_extract(str,
  '\b\d{1,3}\s*-\s*\d{1,4}\b(?:\s*\([^)]{0,24}\))?'), '\s+', ' ', 'g')), '') AS pole_type FROM v_items""")
def _(v):
    return v.items.select("route_id", "item_id", pole_type("str").alias("pole_type"))


@query("p3_digits", r"""SELECT route_id, item_id, CAST(list_filter(regexp_extract_all(str, '\d{1,3}'), lambda r:
  len(r) = list_max(list_transform(regexp_extract_all(str, '\d{1,3}'), lambda q: len(q))))[1] AS INT) AS number FROM v_items""")
def _(v):
    return v.items.select("route_id", "item_id", digits("str").alias("number"))


@query("p4_text_anchor", "SELECT route_id, item_id, round(x + coalesce(width, 0) / 2, 6) AS ax FROM v_items")
def _(v):
    return v.items.select("route_id", "item_id", r6(text_anchor("x", "width")).alias("ax"))


@query("p5_flip_y", "SELECT route_id, number, row_id, 842 - y AS y FROM v_poles")
def _(v):
    return v.poles.select("route_id", "number", "row_id", flip_y("y", F.lit(842.0)).alias("y"))


@query("p6_affine", """WITH m AS (SELECT route_id, number, x, y, 1.5e0 AS a, 0.25e0 AS b, -0.5e0 AS c, 2e0 AS d, 10e0 AS e, 20e0 AS f FROM v_tracks),
 p AS (SELECT route_id, number, a * (2 * x + 3) + c * (0.5e0 * y - 1) + e AS px, b * (2 * x + 3) + d * (0.5e0 * y - 1) + f AS py FROM m)
 SELECT route_id, number, round(px, 6) AS px, round(py, 6) AS py FROM p""")
def _(v):
    struct = lambda *vals: F.struct(*[F.lit(float(x)).alias(k) for k, x in zip("abcdef", vals)])
    both = affine_compose(struct(1.5, 0.25, -0.5, 2, 10, 20), struct(2, 0, 0, 0.5, 3, -1))
    return (v.tracks.withColumn("m", both).withColumn("p", affine_apply("m", "x", "y"))
            .select("route_id", "number", r6("p.x").alias("px"), r6("p.y").alias("py")))


@query("p7_rotate", "SELECT route_id, number, round(cos(0.3e0) * x + sin(0.3e0) * y, 6) AS rx, round(cos(0.3e0) * y - sin(0.3e0) * x, 6) AS ry FROM v_tracks")
def _(v):
    return (v.tracks.withColumn("p", rotate("x", "y", 0.3))
            .select("route_id", "number", r6("p.x").alias("rx"), r6("p.y").alias("ry")))


@query("p8_utm_forward", f"WITH {utm_fwd_ctes('v_tracks')} SELECT route_id, number, zone, round(easting, 4) AS easting, round(northing, 4) AS northing FROM u")
def _(v):
    return (v.tracks.withColumn("u", utm_forward("lat", "lon"))
            .select("route_id", "number", "u.zone", r6("u.easting", 4).alias("easting"), r6("u.northing", 4).alias("northing")))


@query("p9_utm_inverse", f"WITH {utm_inv_ctes('v_tracks')} SELECT route_id, number, round(glat, 9) AS lat, round(glon, 9) AS lon FROM g")
def _(v):
    return (v.tracks.withColumn("g", utm_inverse("e", "n", 22))
            .select("route_id", "number", r6("g.lat", 9).alias("lat"), r6("g.lon", 9).alias("lon")))


@query("p10_page_transform", f"""WITH m AS (SELECT route_id, number, x, y, page, 700000 + page * 1000e0 AS oe, 6900000 - page * 500e0 AS orn, 0.5e0 AS s,
   CASE WHEN page = 1 THEN NULL ELSE page * 0.1e0 END AS th FROM v_tracks),
 q AS (SELECT *, oe + (cos(coalesce(th, 0)) * x + sin(coalesce(th, 0)) * y) * s AS e, orn - (cos(coalesce(th, 0)) * y - sin(coalesce(th, 0)) * x) * s AS n FROM m),
 {utm_inv_ctes('q')}
 SELECT route_id, number, round(e, 6) AS e, round(n, 6) AS n, round(glat, 9) AS lat, round(glon, 9) AS lon, round(x, 6) AS bx, round(y, 6) AS by_ FROM g""")
def _(v):
    args = ("oe", "orn", "s", "s")
    return (v.tracks.selectExpr("route_id", "number", "x", "y", "700000 + page * 1000e0 AS oe", "6900000 - page * 500e0 AS orn",
                                "0.5e0 AS s", "CASE WHEN page = 1 THEN NULL ELSE page * 0.1e0 END AS th")
            .withColumn("u", page_to_utm("x", "y", *args, "th"))
            .withColumn("b", utm_to_page("u.easting", "u.northing", *args, "th"))
            .withColumn("g", page_to_gps("x", "y", *args, 22, "th"))
            .select("route_id", "number", r6("u.easting").alias("e"), r6("u.northing").alias("n"), r6("g.lat", 9).alias("lat"),
                    r6("g.lon", 9).alias("lon"), r6("b.x").alias("bx"), r6("b.y").alias("by_")))


PAIR = "SELECT p.route_id, p.number, p.lat AS la, p.lon AS lo, q.lat AS lb, q.lon AS lp, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, p.e AS e1, p.n AS n1, q.e AS e2, q.n AS n2, p.v FROM v_tracks p JOIN v_tracks q ON q.route_id = p.route_id AND q.number = p.number + 1"


def pairs(v):
    q = v.tracks.selectExpr("route_id", "number - 1 AS number", "lat AS lb", "lon AS lp", "x AS x2", "y AS y2", "e AS e2", "n AS n2")
    return (v.tracks.selectExpr("route_id", "number", "lat AS la", "lon AS lo", "x AS x1", "y AS y1", "e AS e1", "n AS n1", "v")
            .join(q, ["route_id", "number"]))


@query("p11_haversine", f"SELECT route_id, number, round({hav_sql('la', 'lo', 'lb', 'lp')}, 6) AS m FROM ({PAIR})")
def _(v):
    return pairs(v).select("route_id", "number", r6(haversine_m("la", "lo", "lb", "lp")).alias("m"))


BRG = "(degrees(atan2(sin(radians(lp - lo)) * cos(radians(lb)), cos(radians(la)) * sin(radians(lb)) - sin(radians(la)) * cos(radians(lb)) * cos(radians(lp - lo)))) + 360) % 360"


@query("p12_bearing", f"SELECT route_id, number, round({BRG}, 6) AS brg, round((degrees(atan2(x2 - x1, y2 - y1)) + 360) % 360, 6) AS page_brg, round(({BRG} + 180) % 360, 6) AS back FROM ({PAIR})")
def _(v):
    b = bearing_deg("la", "lo", "lb", "lp")
    return pairs(v).select("route_id", "number", r6(b).alias("brg"), r6(page_bearing("x1", "y1", "x2", "y2")).alias("page_brg"),
                           r6(flip_bearing(b)).alias("back"))


@query("p13_destination", """WITH q AS (SELECT route_id, number, radians(lat) AS p, radians(lon) AS l, radians(number * 5) AS b, v / 6371000e0 AS d FROM v_tracks),
 w AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(b)) AS p2 FROM q)
 SELECT route_id, number, round(degrees(p2), 9) AS lat, round(degrees(l + atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin(p2))), 9) AS lon FROM w""")
def _(v):
    return (v.tracks.withColumn("g", destination("lat", "lon", F.col("number") * 5, "v"))
            .select("route_id", "number", r6("g.lat", 9).alias("lat"), r6("g.lon", 9).alias("lon")))


@query("p14_point_segment", """WITH q AS (SELECT route_id, number, x, y, 100e0 AS ax, 290e0 AS ay, 500e0 AS bx, 330e0 AS by_ FROM v_tracks),
 w AS (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM q),
 z AS (SELECT *, ax + t * (bx - ax) AS fx, ay + t * (by_ - ay) AS fy FROM w)
 SELECT route_id, number, round(t, 9) AS t, round(fx, 6) AS fx, round(fy, 6) AS fy, round(sqrt(pow(x - fx, 2) + pow(y - fy, 2)), 6) AS d FROM z""")
def _(v):
    return (v.tracks.withColumn("h", point_segment("x", "y", 100.0, 290.0, 500.0, 330.0))
            .select("route_id", "number", r6("h.t", 9).alias("t"), r6("h.x").alias("fx"), r6("h.y").alias("fy"), r6("h.d").alias("d")))


TRIPLE = """SELECT p.route_id, p.number, p.lat, p.lon, p.x, p.y, a.lat AS la, a.lon AS lo, a.x AS ax, a.y AS ay, b.lat AS lb, b.lon AS lp, b.x AS bx, b.y AS by_
 FROM v_tracks p JOIN v_tracks a ON a.route_id = p.route_id AND a.number = p.number - 1 JOIN v_tracks b ON b.route_id = p.route_id AND b.number = p.number + 1"""
LOCAL = f"""t0 AS (SELECT *, cos(radians((la + lb) / 2)) AS k FROM ({TRIPLE})),
 t1 AS (SELECT *, (lp - lo) * 111320 * k AS mx, (lb - la) * 110540 AS my, (lon - lo) * 111320 * k AS qx, (lat - la) * 110540 AS qy FROM t0),
 t2 AS (SELECT *, mx * mx + my * my AS l2, qx * mx + qy * my AS dt, mx * qy - my * qx AS cr FROM t1)"""


def triples(v):
    a = v.tracks.selectExpr("route_id", "number + 1 AS number", "lat AS la", "lon AS lo", "x AS ax", "y AS ay")
    b = v.tracks.selectExpr("route_id", "number - 1 AS number", "lat AS lb", "lon AS lp", "x AS bx", "y AS by_")
    return v.tracks.select("route_id", "number", "lat", "lon", "x", "y").join(a, ["route_id", "number"]).join(b, ["route_id", "number"])


@query("p15_chord_side", f"""WITH {LOCAL}, s AS (SELECT *, (bx - ax) * (y - ay) - (by_ - ay) * (x - ax) AS pc FROM t2)
 SELECT route_id, number, CASE WHEN pc > 2 THEN 1 WHEN pc < -2 THEN -1 ELSE 0 END AS page_side,
   CASE WHEN cr > 0.15e0 THEN 1 WHEN cr < -0.15e0 THEN -1 ELSE 0 END AS gps_side FROM s""")
def _(v):
    return triples(v).select("route_id", "number", chord_side("x", "y", "ax", "ay", "bx", "by_").alias("page_side"),
                             gps_chord_side("lat", "lon", "la", "lo", "lb", "lp").alias("gps_side"))


@query("p16_lateral", f"""WITH {LOCAL}, s AS (SELECT *, greatest(0, least(1, dt / l2)) AS ft, dt / l2 AS it, abs(cr) / sqrt(l2) AS lat_m FROM t2),
 s2 AS (SELECT *, la + ft * my / 110540 AS fla, lo + ft * mx / (111320 * k) AS flo FROM s),
 s3 AS (SELECT *, {hav_sql('fla', 'flo', 'lat', 'lon')} AS fd FROM s2)
 SELECT route_id, number, round(lat_m, 6) AS lateral, round(fla, 9) AS foot_lat, round(flo, 9) AS foot_lon,
  round(la + (2 * it * my - qy) / 110540, 9) AS mir_lat, round(lo + (2 * it * mx - qx) / (111320 * k), 9) AS mir_lon,
  round(fla + (CASE WHEN fd > 1 THEN 1 / fd ELSE 1 END) * (lat - fla), 9) AS shr_lat, round(flo + (CASE WHEN fd > 1 THEN 1 / fd ELSE 1 END) * (lon - flo), 9) AS shr_lon FROM s3""")
def _(v):
    args = ("lat", "lon", "la", "lo", "lb", "lp")
    df = triples(v).withColumns({"f": gps_foot_on_chord(*args), "m": gps_reflect(*args), "l": gps_lateral_m(*args)})
    df = df.withColumn("s", gps_shrink_lateral("lat", "lon", "f.lat", "f.lon", F.lit(1.0)))
    return df.select("route_id", "number", r6("l").alias("lateral"), r6("f.lat", 9).alias("foot_lat"), r6("f.lon", 9).alias("foot_lon"),
                     r6("m.lat", 9).alias("mir_lat"), r6("m.lon", 9).alias("mir_lon"), r6("s.lat", 9).alias("shr_lat"), r6("s.lon", 9).alias("shr_lon"))


@query("p17_detail_to_overview", """WITH q AS (SELECT route_id, number, x, y, page * 200e0 AS bx, page * 30e0 AS by_, 180e0 AS bw,
  CASE WHEN page = 2 THEN NULL ELSE 0.5e0 END AS sd FROM v_tracks), w AS (SELECT *, coalesce(sd / 2e0, bw / 900e0) AS k FROM q)
 SELECT route_id, number, round(bx + x * k, 6) AS ox, round(by_ + y * k, 6) AS oy FROM w""")
def _(v):
    box = F.expr("named_struct('x', page * 200e0, 'y', page * 30e0, 'w', 180e0, 'h', 120e0)")
    sd = F.expr("CASE WHEN page = 2 THEN NULL ELSE 0.5e0 END")
    return (v.tracks.withColumn("o", detail_to_overview("x", "y", box, 900.0, sd, 2.0))
            .select("route_id", "number", r6("o.x").alias("ox"), r6("o.y").alias("oy")))


@query("p18_span_tolerance", "SELECT route_id, lo, round(least(10, greatest(2, 0.15e0 * meters)), 9) AS tol FROM v_spans WHERE meters IS NOT NULL")
def _(v):
    return v.spans.where("meters IS NOT NULL").select("route_id", "lo", r6(span_tolerance("meters"), 9).alias("tol"))


@query("p19_edge_cost", """WITH q AS (SELECT route_id, lo, greatest(0, abs(30 - meters) - greatest(0.5e0, 0.05e0 * meters)) AS c, source FROM v_spans)
 SELECT route_id, lo, round(coalesce(CASE WHEN source = 'inferred-label' THEN 0.5e0 * c ELSE c END, 0), 9) AS cost
 FROM (SELECT route_id, lo, source, CASE WHEN c IS NULL THEN NULL ELSE c END AS c FROM (SELECT route_id, lo, source, CASE WHEN m IS NULL THEN NULL ELSE c END AS c FROM (SELECT q.*, s.meters AS m FROM q JOIN v_spans s USING (route_id, lo))))""")
def _(v):
    cost = edge_cost(F.lit(30.0), "meters", is_invented("source"))
    return v.spans.select("route_id", "lo", r6(cost, 9).alias("cost"))


@query("p20_trilaterate", """WITH q AS (SELECT route_id, number, e AS ax, n AS ay, e + 20 + v / 10 AS bx, n + 5 AS by_, 12 + v / 50 AS r1, 15 + (number % 7) AS r2, e + 8 AS ex, n + CASE WHEN number % 2 = 0 THEN 9 ELSE -9 END AS ey FROM v_tracks),
 w AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS d FROM q),
 z AS (SELECT *, d >= r1 + r2 AS far, d <= abs(r1 - r2) AS nest FROM w),
 y AS (SELECT *, CASE WHEN far THEN d * r1 / (r1 + r2) WHEN nest THEN r1 ELSE (d * d + r1 * r1 - r2 * r2) / (2 * d) END AS al FROM z),
 h AS (SELECT *, CASE WHEN far OR nest THEN 0 ELSE sqrt(greatest(0, r1 * r1 - al * al)) END AS hh, (bx - ax) / d AS ux, (by_ - ay) / d AS uy FROM y),
 c AS (SELECT *, ax + al * ux - hh * uy AS x1, ay + al * uy + hh * ux AS y1, ax + al * ux + hh * uy AS x2, ay + al * uy - hh * ux AS y2 FROM h),
 k AS (SELECT *, sqrt(pow(x1 - ex, 2) + pow(y1 - ey, 2)) <= sqrt(pow(x2 - ex, 2) + pow(y2 - ey, 2)) AS one FROM c)
 SELECT route_id, number, round(CASE WHEN one THEN x1 ELSE x2 END, 4) AS x, round(CASE WHEN one THEN y1 ELSE y2 END, 4) AS y FROM k""")
def _(v):
    q = v.tracks.selectExpr("route_id", "number", "e AS ax", "n AS ay", "e + 20 + v / 10 AS bx", "n + 5 AS by_", "12 + v / 50 AS r1",
                            "15 + (number % 7) AS r2", "e + 8 AS ex", "n + CASE WHEN number % 2 = 0 THEN 9 ELSE -9 END AS ey")
    return (q.withColumn("p", trilaterate("ax", "ay", "r1", "bx", "by_", "r2", "ex", "ey"))
            .select("route_id", "number", r6("p.x", 4).alias("x"), r6("p.y", 4).alias("y")))


@query("p21_accuracy_tier", "SELECT route_id, number, CASE WHEN v <= 5 THEN 'perfect' WHEN v <= 10 THEN 'good' WHEN v <= 15 THEN 'acceptable' ELSE 'bad' END AS tier FROM v_tracks")
def _(v):
    return v.tracks.select("route_id", "number", accuracy_tier("v").alias("tier"))


@query("p22_source_rank", """SELECT route_id, lo, hi, CASE source WHEN 'override' THEN 4 WHEN 'bifurcation-main' THEN 3 WHEN 'bifurcation-tap' THEN 3
 WHEN 'branch-arm-rehomed' THEN 3 WHEN 'inferred-label' THEN 2 WHEN 'legacy-midpoint' THEN 1 ELSE 0 END AS rank FROM v_all_spans""")
def _(v):
    return v.all_spans.select("route_id", "lo", "hi", source_rank("source").alias("rank"))


@query("p23_source_flags", """SELECT route_id, lo, hi, source IN ('jumpback-refill', 'inferred-label', 'window-refine-duplicate') AS invented,
 source IN ('bifurcation-main', 'branch-arm-rehomed', 'branch-arm-rehomed-cross-page', 'branch-arm-rehomed-topology', 'override') AS authoritative FROM v_all_spans""")
def _(v):
    return v.all_spans.select("route_id", "lo", "hi", is_invented("source").alias("invented"), is_authoritative("source").alias("authoritative"))


@query("p24_text_formats", """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped,
 CASE WHEN doc_id < 10 THEN '0' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS padded, lower('ff' || substr(hx, 5, 2) || substr(hx, 3, 2) || substr(hx, 1, 2)) AS color,
 'ff' || CASE WHEN lang = 'en' THEN '0000ff' ELSE '00ff00' END AS icon
 FROM (SELECT *, CASE WHEN lang = 'en' THEN 'A1B2C3' ELSE '00FF7f' END AS hx FROM documents)""")
def _(v):
    docs = v.table("documents").withColumn("hx", F.when(F.col("lang") == "en", "#A1B2C3").otherwise("00FF7f"))
    options = style_options(F.when(F.col("lang") == "en", F.create_map(F.lit("iconColor"), F.lit("red"))))
    return docs.select("doc_id", xml_escape("text").alias("escaped"), pad_number("doc_id").alias("padded"),
                       kml_color("hx").alias("color"), options["iconColorKml"].alias("icon"))


@query("p25_sanitize_id", "SELECT page_id, coalesce(nullif(substr(regexp_replace(trim(url), '[^a-zA-Z0-9._-]', '_', 'g'), 1, 120), ''), 'region') AS id FROM pages")
def _(v):
    return v.table("pages").select("page_id", sanitize_id("url").alias("id"))


@query("p26_mirror_number", "SELECT t.route_id, number, page, lo + hi - number AS mirrored FROM v_tracks t JOIN (SELECT route_id, page, min(number) AS lo, max(number) AS hi FROM v_tracks GROUP BY ALL) USING (route_id, page)")
def _(v):
    ends = v.tracks.groupBy("route_id", "page").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    return (v.tracks.join(ends, ["route_id", "page"])
            .select("route_id", "number", "page", mirror_number("number", "lo", "hi").alias("mirrored")))


@query("p28_misread", """WITH q AS (SELECT route_id, pos, number AS n, pos AS e, pos - number AS g FROM v_readings)
 SELECT route_id, pos, coalesce(n <> e AND ((n <= 9 AND e >= 50 AND ends_with(CAST(e AS VARCHAR), CAST(n AS VARCHAR))) OR (g = 30 AND n BETWEEN 35 AND 45 AND e >= 65)
   OR (g = 20 AND n BETWEEN 25 AND 35 AND e >= 45) OR (g >= 50 AND n <= 9 AND e >= 50)), false) AS truncated,
  CASE WHEN n BETWEEN 86 AND 99 THEN array_to_string(list_filter([n - 40, n - 38], lambda c: c >= 1 AND c <= 64), ',') ELSE '' END AS repairs FROM q""")
def _(v):
    return v.readings.select("route_id", "pos", is_truncated("number", "pos").alias("truncated"),
                             F.concat_ws(",", F.transform(nineties_candidates("number", 64), lambda c: c.cast("string"))).alias("repairs"))


@query("p29_ratio_penalty", """SELECT route_id, lo, round(coalesce(35 * abs(ln(60 * 0.5e0 / meters)), 0), 6) AS penalty, coalesce(60 * 0.5e0 / meters BETWEEN 0.35e0 AND 2.5e0, true) AS plausible FROM v_spans""")
def _(v):
    return (v.spans.withColumn("p", ratio_penalty(F.lit(60.0), F.lit(0.5), "meters"))
            .select("route_id", "lo", r6("p.penalty").alias("penalty"), "p.plausible"))


@query("p30_degree_class", "SELECT route_id, n, CASE WHEN n <= 1 THEN 1 WHEN n = 2 THEN 2 ELSE 3 END AS class FROM (SELECT route_id, count(*) AS n FROM v_poles GROUP BY route_id)")
def _(v):
    return v.poles.groupBy("route_id").agg(F.count("*").alias("n")).select("route_id", "n", degree_class("n").alias("class"))


NORM = "lower(strip_accents(layer))"


@query("f1_layer_roles", f"""WITH q AS (SELECT route_id, item_id, layer, {NORM} AS n FROM v_items),
 w AS (SELECT *, n IN ('texto', 'numero_poste') OR (contains(n, 'moldura') AND contains(n, 'intelig')) OR starts_with(n, 'texto_') AS seqn FROM q)
 SELECT route_id, item_id, layer, array_to_string(list_filter([CASE WHEN n IN ('0', 'numero_poste') OR (contains(n, 'numero') AND contains(n, 'poste')) THEN 'circle' END,
  CASE WHEN n = 'poste' THEN 'pole_graphic' END, CASE WHEN seqn OR n = 'poste' THEN 'pole_label' END, CASE WHEN seqn THEN 'sequence_number' END,
  CASE WHEN n = 'distancia_poste' THEN 'span_label' END, CASE WHEN n = 'utm' THEN 'utm_grid' END, CASE WHEN n = 'padrao' THEN 'viewport' END], lambda r: r IS NOT NULL), ',') AS roles FROM w""")
def _(v):
    return fl.with_layer_role(v.items).select("route_id", "item_id", "layer", F.concat_ws(",", "roles").alias("roles"))


@query("f2_missing_layers", f"""WITH q AS (SELECT route_id, list({NORM}) AS ls FROM v_items GROUP BY route_id),
 w AS (SELECT route_id, list_filter([CASE WHEN NOT list_contains(ls, 'numero_poste') THEN 'Numero_Poste' END, CASE WHEN NOT list_contains(ls, 'texto') THEN 'TEXTO' END,
  CASE WHEN NOT list_contains(ls, 'distancia_poste') THEN 'Distância_Poste' END, CASE WHEN NOT list_contains(ls, 'cabo projetado') THEN 'Cabo Projetado' END], lambda r: r IS NOT NULL) AS m FROM q)
 SELECT route_id, array_to_string(m, ',') AS missing FROM w WHERE len(m) > 0""")
def _(v):
    return fl.missing_layers(v.items).select("route_id", F.concat_ws(",", "missing").alias("missing"))


@query("f3_fallback", f"""WITH p AS (SELECT route_id, item_id, str FROM v_items WHERE {NORM} = 'distancia_poste')
 SELECT * FROM p UNION ALL SELECT route_id, item_id, str FROM v_items WHERE route_id NOT IN (SELECT route_id FROM p)""")
def _(v):
    items = v.items
    primary = items.where(fl.role_matches("layer", "span_label"))
    return fl.with_fallback(primary, items).select("route_id", "item_id", "str")


@query("f4_plausible_numbers", "SELECT route_id, pos, number, coalesce(number BETWEEN 1 AND n, false) AS in_range FROM v_readings JOIN (SELECT route_id, count(*) AS n FROM v_readings GROUP BY 1) USING (route_id)")
def _(v):
    return fl.plausible_numbers(v.readings).select("route_id", "pos", "number", "in_range")


@query("f5_suspicious_numbering", "SELECT route_id, max(number) AS max_number, count(*) AS n_poles FROM v_poles GROUP BY 1 HAVING max(number) > 3 * count(*)")
def _(v):
    return fl.suspicious_numbering(v.poles)


@query("f6_country_bounds", "SELECT vec_id, embedding[1] * 300e0 BETWEEN -34 AND 5 AND embedding[2] * 300e0 BETWEEN -74 AND -35 AS inside FROM embeddings")
def _(v):
    return v.table("embeddings").select("vec_id", in_warn_bounds(F.col("embedding")[0] * F.lit(300.0), F.col("embedding")[1] * F.lit(300.0)).alias("inside"))


@query("f7_zone_envelope", "SELECT idx, x + (idx % 3) * 90000 BETWEEN 600000 AND 800000 AND y BETWEEN 6700000 AND 7100000 AS inside FROM v_base")
def _(v):
    return v.base.select("idx", in_zone_envelope(F.col("x") + (F.col("idx") % 3) * 90000, "y").alias("inside"))


EXT = """ext AS (SELECT region_id, (CASE region_id % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 1000e0 WHEN 2 THEN 7e0 ELSE 1e0 END) AS k,
  min(x) AS px0, min(y) AS py0, max(x) AS px1, max(y) AS py1 FROM v_base GROUP BY region_id),
 sc AS (SELECT *, CASE WHEN k = 0 THEN 'inferred' WHEN k = 1 THEN 'high' WHEN k = 1000 THEN 'low' END AS confidence,
  CASE WHEN k IN (0, 1) THEN 1e0 WHEN k = 1000 THEN 0.001e0 END AS scale FROM ext),
 ee AS (SELECT *, CASE WHEN k = 0 THEN px0 ELSE px0 * k * scale END AS e0, CASE WHEN k = 0 THEN py0 ELSE py0 * k * scale END AS n0,
  CASE WHEN k = 0 THEN px1 ELSE px1 * k * scale END AS e1, CASE WHEN k = 0 THEN py1 ELSE py1 * k * scale END AS n1 FROM sc)"""


def region_extents(v):
    k = F.expr("CASE region_id % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 1000e0 WHEN 2 THEN 7e0 ELSE 1e0 END")
    return (v.base.groupBy("region_id").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
            .withColumns({c: F.col(c) * k for c in ("min_x", "min_y", "max_x", "max_y")}))


@query("f8_georeference", f"""WITH {EXT}, {utm_inv_ctes('ee', 'e0', 'n0', '22', 'ga')}, gb_in AS (SELECT * RENAME (glat AS lat0, glon AS lon0) FROM ga),
 {utm_inv_ctes('gb_in', 'e1', 'n1', '22', 'gb')}
 SELECT region_id, scale, confidence, CASE WHEN scale IS NULL THEN 'unit mismatch' END AS error, round(e0, 4) AS e0, round(n1, 4) AS n1,
  round(least(lat0, glat), 8) AS min_lat, round(greatest(lon0, glon), 8) AS max_lon FROM gb""")
def _(v):
    out = fl.resolve_georeference(region_extents(v), v.base)
    return out.select("region_id", "scale", "confidence", "error", r6("e0", 4).alias("e0"), r6("n1", 4).alias("n1"),
                      r6("min_lat", 8).alias("min_lat"), r6("max_lon", 8).alias("max_lon"))


@query("f9_zone_mismatch", """SELECT route_id, number, CAST(floor((lon + 180) / 6) AS BIGINT) + 1 AS anchor_zone, zone FROM v_tracks
 JOIN (SELECT n_nationkey AS region_id, 20 + n_regionkey AS zone FROM nation) r ON r.region_id = v_tracks.route_id % 25 WHERE CAST(floor((lon + 180) / 6) AS BIGINT) + 1 <> zone""")
def _(v):
    regions = v.table("nation").selectExpr("CAST(n_nationkey AS BIGINT) AS region_id", "20 + n_regionkey AS zone")
    anchors = v.tracks.withColumn("region_id", F.col("route_id") % 25)
    return fl.zone_mismatch(anchors, regions).select("route_id", "number", "anchor_zone", "zone")


@query("f10_in_bbox", """SELECT edge_id, ax BETWEEN 700100 AND 702500 AND ay BETWEEN 6898500 AND 6899500 AND bx BETWEEN 700100 AND 702500 AND "by" BETWEEN 6898500 AND 6899500 AS inside FROM v_base_edges""")
def _(v):
    box = (700100.0, 6898500.0, 702500.0, 6899500.0)
    return v.base_edges.select("edge_id", (in_bbox("ax", "ay", *box) & in_bbox("bx", "by", *box)).alias("inside"))


@query("f11_span_predicates", """SELECT route_id, lo, hi, coalesce(meters > 0, false) AS active, meters IS NULL AND source IN ('jumpback-suppressed', 'bifurcation-cleared') AS blocked FROM v_all_spans""")
def _(v):
    return v.all_spans.select("route_id", "lo", "hi", has_active_metres("meters").alias("active"), is_blocked("meters", "source").alias("blocked"))


@query("f11_tap_legs", """WITH a AS (SELECT route_id, lo, hi FROM v_all_spans WHERE meters > 0)
 SELECT n.route_id, n.lo + 1 AS lo, n.lo + 2 AS hi FROM a n JOIN a o ON o.route_id = n.route_id AND o.lo = n.lo AND o.hi = n.lo + 2
 WHERE n.hi = n.lo + 1 AND NOT EXISTS (SELECT 1 FROM a z WHERE z.route_id = n.route_id AND z.lo = n.lo + 1 AND z.hi = n.lo + 2)""")
def _(v):
    return fl.tap_legs(v.all_spans)


COORD = """CASE row_id % 5 WHEN 0 THEN concat(' ', a, ', ', b, ' ') WHEN 1 THEN concat(a, ' ', b) WHEN 2 THEN concat(a, ';', b) WHEN 3 THEN concat('1', a, ',', b) ELSE concat(a, ',', b, ',1') END"""
COORD_SRC = "SELECT route_id, number, row_id, CAST(CAST(abs(lat) AS DECIMAL(9,5)) AS VARCHAR(16)) AS a, CAST(CAST(lon AS DECIMAL(9,5)) AS VARCHAR(16)) AS b FROM {t}"


@query("f12_parse_coordinate", f"""WITH q AS ({COORD_SRC.format(t='v_tracks')}), w AS (SELECT *, trim({COORD}) AS s FROM q),
 z AS (SELECT *, regexp_full_match(s, '-?\\d+(\\.\\d+)?(\\s*,\\s*|\\s+)-?\\d+(\\.\\d+)?') AS ok, try_cast(regexp_extract(s, '^(-?\\d+(\\.\\d+)?)', 1) AS DOUBLE) AS lat, try_cast(regexp_extract(s, '(-?\\d+(\\.\\d+)?)$', 1) AS DOUBLE) AS lon FROM w)
 SELECT route_id, number, CASE WHEN ok AND lat BETWEEN -90 AND 90 THEN lat END AS lat, CASE WHEN ok AND lat BETWEEN -90 AND 90 THEN lon END AS lon FROM z""")
def _(v):
    src = v.tracks.selectExpr("route_id", "number", "row_id", "CAST(CAST(abs(lat) AS DECIMAL(9,5)) AS VARCHAR(16)) AS a", "CAST(CAST(lon AS DECIMAL(9,5)) AS VARCHAR(16)) AS b")
    return (src.withColumn("c", parse_coordinate(F.expr(COORD))).select("route_id", "number", "c.lat", "c.lon"))


@query("f13_label_sanity", f"""WITH q AS (SELECT s.route_id, s.lo AS src, s.hi AS dst, meters, {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM v_spans s
 JOIN v_truth a ON a.route_id = s.route_id AND a.number = s.lo JOIN v_truth b ON b.route_id = s.route_id AND b.number = s.hi
 WHERE meters > 0 AND source <> 'inferred-label' AND a.lat IS NOT NULL AND b.lat IS NOT NULL)
 SELECT route_id, src, dst, round(m, 6) AS computed_m FROM q WHERE abs(m - meters) > greatest(5, 0.1e0 * meters)""")
def _(v):
    conns = v.spans.selectExpr("route_id", "lo AS src", "hi AS dst", "meters", "source = 'inferred-label' AS gap")
    return rounded(fl.label_sanity(conns, v.truth).select("route_id", "src", "dst", "computed_m"), "computed_m")


@query("f16_utm_in_country", f"""WITH q AS (SELECT idx, x, y + (idx % 4) * 1500000 AS yy FROM v_base), {utm_inv_ctes('q', 'x', 'yy')}
 SELECT idx, glat BETWEEN -33.8e0 AND 5.3e0 AND glon BETWEEN -73 AND -34.8e0 AS inside FROM g""")
def _(v):
    return v.base.select("idx", utm_in_country("x", F.col("y") + (F.col("idx") % 4) * 1500000, 22).alias("inside"))
