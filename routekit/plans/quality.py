"""Trust gates, error reports and region lookups over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from routekit.operators import quality as q
from routekit.operators import regions as rg
from routekit.plans.registry import query, r6, rounded
from routekit.plans.scalars import hav_sql

RES = f"""res AS (SELECT s.route_id, s.lo, s.hi, s.meters, s.source, {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS hav FROM v_spans s
 JOIN v_truth a ON a.route_id = s.route_id AND a.number = s.lo JOIN v_truth b ON b.route_id = s.route_id AND b.number = s.hi
 WHERE meters > 0 AND a.lat IS NOT NULL AND b.lat IS NOT NULL),
 re AS (SELECT *, abs(hav - meters) / meters AS rel, abs(hav - meters) AS rm FROM res),
 sh AS (SELECT route_id, count(*) AS edge_count, list_sort(list(rel))[CAST(floor(count(*) / 2e0) AS INT) + 1] AS median_rel,
   list_sort(list(rel))[CAST(ceil(count(*) * 0.95e0) AS INT)] AS p95_rel FROM re GROUP BY route_id)"""
GAP = f"""gp AS (SELECT a.route_id, a.number, {hav_sql('a.lat', 'a.lon', 't.lat', 't.lon')} AS gap_m FROM v_truth a JOIN v_tracks t USING (route_id, number) WHERE a.lat IS NOT NULL),
 ag AS (SELECT route_id, count(*) AS pole_count, avg(gap_m) AS mean_gap, list_sort(list(gap_m))[CAST(ceil(count(*) * 0.95e0) AS INT)] AS p95_gap FROM gp GROUP BY route_id)"""
WI = """wi AS (SELECT route_id, number, max(rel) AS worst_rel, arg_max(rm, rel) AS worst_m FROM (SELECT route_id, lo AS number, rel, rm FROM re UNION ALL SELECT route_id, hi, rel, rm FROM re) GROUP BY ALL)"""
DEC = """de AS (SELECT coalesce(sh.route_id, ag.route_id) AS route_id, CASE WHEN coalesce(median_rel < 0.05e0, false) AND coalesce(p95_gap < 10, false) THEN 'trust'
  WHEN coalesce(median_rel >= 0.15e0, false) OR coalesce(p95_gap >= 20, false) THEN 'fail' ELSE 'fallback' END AS decision, median_rel, p95_gap FROM sh FULL JOIN ag ON sh.route_id = ag.route_id)"""
TIER = """ti AS (SELECT u.route_id, u.number, CASE WHEN worst_rel IS NULL AND gap_m IS NULL THEN 'UNRESOLVABLE' WHEN coalesce(worst_rel < 0.05e0, false) AND coalesce(gap_m < 10, false) THEN 'HIGH'
  WHEN coalesce(worst_rel >= 0.15e0, false) OR coalesce(gap_m >= 15, false) THEN 'LOW' ELSE 'MED' END AS tier, worst_m, gap_m
  FROM v_tracks u LEFT JOIN wi USING (route_id, number) LEFT JOIN gp USING (route_id, number))"""


def residual_rows(v):
    return q.residuals(v.truth, v.spans)


def gap_rows(v):
    return q.anchor_gaps(v.truth, v.tracks)


def decisions(v):
    return q.route_decision(q.residual_summary(residual_rows(v)), q.anchor_gap_summary(gap_rows(v)))


def tiers(v):
    return q.pole_tiers(v.tracks, q.worst_incident(residual_rows(v)), gap_rows(v))


@query("a1_residuals", f"WITH {RES} SELECT route_id, lo, hi, source, round(hav, 6) AS hav, round(rel, 9) AS rel_error, round(rm, 6) AS residual_m FROM re")
def _(v):
    return residual_rows(v).select("route_id", "lo", "hi", "source", r6("hav").alias("hav"), r6("rel_error", 9).alias("rel_error"), r6("residual_m").alias("residual_m"))


@query("a1_residual_summary", f"WITH {RES} SELECT route_id, edge_count, round(median_rel, 9) AS median_rel, round(p95_rel, 9) AS p95_rel FROM sh")
def _(v):
    return rounded(q.residual_summary(residual_rows(v)), "median_rel", "p95_rel", places=9)


@query("a2_anchor_gap", f"WITH {GAP} SELECT route_id, pole_count, round(mean_gap, 6) AS mean_gap, round(p95_gap, 6) AS p95_gap FROM ag")
def _(v):
    return rounded(q.anchor_gap_summary(gap_rows(v)), "mean_gap", "p95_gap")


@query("a3_median_crossval", """WITH p AS (SELECT CAST(floor(route_id / 8e0) AS BIGINT) AS region_id, median(meters) AS mp FROM v_spans WHERE meters > 0 GROUP BY 1),
 d AS (SELECT region_id, median(sqrt(pow(bx - ax, 2) + pow("by" - ay, 2)) * CASE WHEN region_id % 3 = 0 THEN 5e0 ELSE 1e0 END) AS md FROM v_base_edges GROUP BY 1)
 SELECT region_id, mp / md BETWEEN 0.5e0 AND 2 AS ok, CASE WHEN mp / md NOT BETWEEN 0.5e0 AND 2 THEN 'scale-mismatch' END AS reason, round(mp, 6) AS median_printed, round(md, 6) AS median_drawn,
 round(mp / md, 6) AS ratio, CASE WHEN mp / md BETWEEN 0.5e0 AND 2 THEN round(0.15e0 * mp, 9) END AS span_tol_m, CASE WHEN mp / md BETWEEN 0.5e0 AND 2 THEN round(2 * mp, 6) END AS window_m FROM p JOIN d USING (region_id)""")
def _(v):
    spans = v.spans.withColumn("region_id", F.floor(F.col("route_id") / 8))
    k = F.when(F.col("region_id") % 3 == 0, 5.0).otherwise(1.0)
    edges = v.base_edges.withColumns({c: F.col(c) * k for c in ("ax", "ay", "bx", "by")})
    out = q.median_crossval(spans, edges, "region_id")
    return rounded(rounded(out, "median_printed", "median_drawn", "ratio", "window_m"), "span_tol_m", places=9)


@query("a12_span_rmse", f"""WITH {RES}, g AS (SELECT route_id, count(*) AS n, sqrt(avg(rm * rm)) AS rmse FROM re GROUP BY 1),
 w AS (SELECT s.route_id, sqrt(avg(pow(sqrt(pow(a.e - b.e, 2) + pow(a.n - b.n, 2)) - meters, 2))) AS rmse_utm FROM v_spans s JOIN v_tracks a ON a.route_id = s.route_id AND a.number = s.lo
  JOIN v_tracks b ON b.route_id = s.route_id AND b.number = s.hi WHERE meters > 0 GROUP BY 1)
 SELECT route_id, n, round(rmse, 6) AS rmse, round(rmse_utm, 6) AS rmse_utm FROM g JOIN w USING (route_id)""")
def _(v):
    gps = q.span_rmse(v.truth, v.spans)
    utm = q.span_rmse(v.tracks, v.spans, "utm").select("route_id", F.col("rmse").alias("rmse_utm"))
    return rounded(gps.join(utm, "route_id"), "rmse", "rmse_utm")


@query("a15_label_degree", """WITH e AS (SELECT route_id, lo AS number, hi AS o, source FROM v_all_spans WHERE meters > 0 UNION SELECT route_id, hi, lo, source FROM v_all_spans WHERE meters > 0)
 SELECT route_id, number, count(DISTINCT o) AS degree, count(DISTINCT CASE WHEN source = 'bifurcation-main' THEN o END) AS trusted FROM e GROUP BY 1, 2""")
def _(v):
    trusted = q.label_degree(v.all_spans, True).withColumnRenamed("degree", "trusted")
    return q.label_degree(v.all_spans).join(trusted, ["route_id", "number"], "left").fillna({"trusted": 0})


@query("a19_worst_incident", f"WITH {RES}, {WI} SELECT route_id, number, round(worst_rel, 9) AS worst_rel, round(worst_m, 6) AS worst_m FROM wi")
def _(v):
    return rounded(rounded(q.worst_incident(residual_rows(v)), "worst_m"), "worst_rel", places=9)


@query("k1_route_decision", f"WITH {RES}, {GAP}, {DEC} SELECT route_id, decision, CASE WHEN median_rel < 0.05e0 THEN 'trust' WHEN median_rel >= 0.15e0 THEN 'fail' ELSE 'fallback' END AS advisory FROM de")
def _(v):
    shape, gap = q.residual_summary(residual_rows(v)), q.anchor_gap_summary(gap_rows(v))
    advisory = q.route_decision(shape, gap, advisory=True).select("route_id", F.col("decision").alias("advisory"))
    return q.route_decision(shape, gap).select("route_id", "decision").join(advisory, "route_id")


@query("k2_pole_tiers", f"WITH {RES}, {GAP}, {WI}, {TIER} SELECT route_id, number, tier, round(worst_m, 6) AS shape_residual_m, round(gap_m, 6) AS anchor_gap_m FROM ti")
def _(v):
    return rounded(tiers(v).join(v.tracks.select("route_id", "number"), ["route_id", "number"], "left_semi"), "shape_residual_m", "anchor_gap_m")


OVERALL = f"""WITH {RES}, {GAP}, {WI}, {DEC}, {TIER}, wo AS (SELECT route_id, max(CASE tier WHEN 'HIGH' THEN 1 WHEN 'MED' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END) AS s FROM ti GROUP BY 1)"""


@query("k3_overall_tier", f"""{OVERALL} SELECT route_id, decision, CASE s WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MED' WHEN 3 THEN 'LOW' ELSE 'UNRESOLVABLE' END AS worst,
  CASE WHEN decision = 'trust' AND s = 1 THEN 'high' WHEN s = 4 THEN 'unresolvable' WHEN s = 3 THEN 'low' ELSE 'med' END AS overall FROM de JOIN wo USING (route_id)""")
def _(v):
    return q.overall_tier(decisions(v), tiers(v))


@query("o7_worst_tier", f"{OVERALL} SELECT route_id, CASE s WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MED' WHEN 3 THEN 'LOW' ELSE 'UNRESOLVABLE' END AS worst FROM wo")
def _(v):
    return q.worst_tier(tiers(v))


ERR = f"""er AS (SELECT t.route_id, t.number, CASE WHEN r.source = 'click' THEN NULL ELSE {hav_sql('t.lat', 't.lon', 'r.lat', 'r.lon')} END AS err_m FROM v_truth t JOIN v_tracks r USING (route_id, number) WHERE t.lat IS NOT NULL)"""


def placed(v):
    return v.tracks.withColumns({c: F.when(F.col("source") != "click", F.col(c)) for c in ("lat", "lon")})


def errors(v):
    return q.compare_truth(placed(v), v.truth)


@query("j15_compare_truth", f"WITH {ERR} SELECT route_id, number, round(err_m, 6) AS err_m FROM er")
def _(v):
    return rounded(errors(v), "err_m")


@query("a17_tier_histogram", f"""WITH {ERR} SELECT route_id, count(*) FILTER (err_m <= 5) AS perfect, count(*) FILTER (err_m > 5 AND err_m <= 10) AS good, count(*) FILTER (err_m > 10 AND err_m <= 15) AS acceptable,
 count(*) FILTER (err_m > 15) AS bad, count(*) - count(err_m) AS unmatched FROM er GROUP BY 1""")
def _(v):
    return q.tier_histogram(errors(v))


@query("a17_bad_poles", f"WITH {ERR} SELECT route_id, number, round(err_m, 6) AS err_m FROM er WHERE err_m > 15")
def _(v):
    return rounded(q.bad_poles(errors(v)), "err_m")


@query("a18_error_summary", f"WITH {ERR} SELECT route_id, count(err_m) AS matched, count(*) AS declared, round(avg(err_m), 6) AS mean_err_m, round(max(err_m), 6) AS max_err_m FROM er GROUP BY 1")
def _(v):
    return rounded(q.error_summary(errors(v)), "mean_err_m", "max_err_m")


@query("k5_regression_gate", f"""WITH {ERR}, ce AS (SELECT t.route_id, t.number, ceil(({hav_sql('t.lat', 't.lon', 'r.lat', 'r.lon')} * 0.9e0 + 0.5e0) * 10) / 10 AS c FROM v_truth t JOIN v_tracks r USING (route_id, number) WHERE t.lat IS NOT NULL)
 SELECT route_id, count(*) FILTER (err_m IS NULL) AS missing, count(*) FILTER (err_m > c) AS over, count(*) FILTER (err_m IS NULL OR err_m > c) = 0 AS passed FROM ce JOIN er USING (route_id, number) GROUP BY 1""")
def _(v):
    recorded = q.compare_truth(v.tracks, v.truth).withColumn("err_m", F.col("err_m") * 0.9)
    return q.regression_gate(errors(v), q.error_ceilings(recorded))


@query("k6_bad_tier_gate", f"""WITH {ERR} SELECT route_id, count(*) FILTER (err_m > 15) AS bad, count(*) FILTER (err_m > 15) = 0 AS passed FROM er
 WHERE NOT EXISTS (SELECT 1 FROM v_tracks x WHERE x.route_id = er.route_id AND x.number = er.number AND x.source = 'error') GROUP BY 1""")
def _(v):
    return q.bad_tier_gate(errors(v), v.tracks.where("source = 'error'"))


@query("k7_position_gate", """SELECT t.route_id, t.number, round(sqrt(pow(t.x + t.v / 5 - p.x, 2) + pow(t.y - p.y, 2)), 6) AS err_pt, coalesce(sqrt(pow(t.x + t.v / 5 - p.x, 2) + pow(t.y - p.y, 2)) <= 50, false) AS passed
 FROM v_tracks t LEFT JOIN (SELECT * FROM v_tracks WHERE source <> 'click') p USING (route_id, number)""")
def _(v):
    truth = v.tracks.select("route_id", "number", (F.col("x") + F.col("v") / 5).alias("x"), "y")
    return rounded(q.position_gate(v.tracks.where("source <> 'click'"), truth), "err_pt")


CAS = "SELECT route_id, CAST(page AS BIGINT) AS priority, concat('method-', page) AS method, max(v) < 60 + 60 * page AS accepted, concat('max ', CAST(CAST(floor(max(v)) AS BIGINT) AS VARCHAR(9))) AS reason FROM v_tracks GROUP BY route_id, page"


@query("k8_cascade", f"""WITH r AS ({CAS}), w AS (SELECT route_id, min(priority) FILTER (accepted) AS priority FROM r GROUP BY 1)
 SELECT w.route_id, w.priority, concat('method-', w.priority) AS method_, (SELECT string_agg(concat(r.method, ':', r.reason), '|' ORDER BY r.priority) FROM r WHERE r.route_id = w.route_id AND (w.priority IS NULL OR r.priority < w.priority)) AS demotions FROM w""")
def _(v):
    level = F.max("v")
    rows = (v.tracks.groupBy("route_id", "page").agg(level.alias("_m"))
            .select("route_id", F.col("page").alias("priority"), F.concat(F.lit("method-"), F.col("page").cast("string")).alias("method"),
                    (F.col("_m") < 60 + 60 * F.col("page")).alias("accepted"), F.concat(F.lit("max "), F.floor("_m").cast("string")).alias("reason")))
    out = q.cascade(rows)
    text = F.array_join(F.transform("demotions", lambda d: F.concat(d["method"], F.lit(":"), d["reason"])), "|")
    return out.select("route_id", "priority", F.coalesce("method", F.lit("method-")).alias("method_"), text.alias("demotions"))


@query("a20_bbox", "SELECT route_id, min(x) - 200 AS min_x, min(y) - 200 AS min_y, max(x) + 200 AS max_x, max(y) + 200 AS max_y FROM v_poles GROUP BY 1")
def _(v):
    return q.bbox(v.poles, "route_id", margin=200.0)


@query("a21_chain_stats", "SELECT route_id, count(*) AS n, round(sum(meters), 6) AS total_m, round(median(meters), 6) AS median_m FROM v_spans WHERE meters > 0 GROUP BY 1")
def _(v):
    return rounded(q.chain_stats(v.spans), "total_m", "median_m")


@query("a23_drop_far_points", f"""WITH p AS (SELECT route_id, number, lat, lon + CASE WHEN number % 9 = 0 THEN 0.03e0 ELSE 0 END AS lon FROM v_tracks), m AS (SELECT route_id, median(lat) AS mla, median(lon) AS mlo FROM p GROUP BY 1)
 SELECT route_id, number, round(lat, 7) AS lat, round(lon, 7) AS lon FROM p JOIN m USING (route_id) WHERE {hav_sql('lat', 'lon', 'mla', 'mlo')} <= 2000""")
def _(v):
    points = v.tracks.select("route_id", "number", "lat", (F.col("lon") + F.when(F.col("number") % 9 == 0, 0.03).otherwise(0.0)).alias("lon"))
    return rounded(q.drop_far_points(points), "lat", "lon", places=7)


@query("a24_build_stats", """WITH l AS (SELECT route_id, number % 3 + 1 AS np, source = 'view' AS mg FROM v_tracks), a AS (SELECT route_id, count(*) FILTER (source <> 'click') AS placemarks, count(*) FILTER (source = 'click') AS omitted FROM v_tracks GROUP BY 1)
 SELECT route_id, placemarks, omitted, count(*) FILTER (NOT mg AND np >= 2) AS lines, count(*) FILTER (mg OR np < 2) AS skipped FROM a JOIN l USING (route_id) GROUP BY ALL""")
def _(v):
    lines = v.tracks.selectExpr("route_id", "number % 3 + 1 AS n_points", "source = 'view' AS missing_gps")
    return q.build_stats(placed(v), lines)


PTS = "SELECT row_id AS point_id, lat - (row_id % 10) * 2e-3 + 4e-3 AS lat, lon FROM v_tracks"
LOOK = f"""pt AS ({PTS}), hit AS (SELECT point_id, r.region_id, row_number() OVER (PARTITION BY point_id ORDER BY (max_lat - min_lat) * (max_lon - min_lon), r.region_id) AS k
  FROM pt JOIN v_regions r ON lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon)"""


def points(v):
    return v.tracks.selectExpr("row_id AS point_id", "lat - (row_id % 10) * 2e-3 + 4e-3 AS lat", "lon")


@query("j10_lookup_region", f"WITH {LOOK} SELECT point_id, region_id FROM hit WHERE k = 1")
def _(v):
    return rg.lookup_region(points(v), v.regions)


@query("k9_missing_regions", f"""WITH {LOOK}, mi AS (SELECT * FROM pt WHERE point_id NOT IN (SELECT point_id FROM hit)),
 c AS (SELECT region_id, name, (min_lat + max_lat) / 2 AS cla, (min_lon + max_lon) / 2 AS clo FROM v_regions)
 SELECT point_id, arg_min(name, km) AS nearest_name, round(min(km), 6) AS distance_km FROM (SELECT point_id, name, {hav_sql('lat', 'lon', 'cla', 'clo')} / 1000 AS km FROM mi CROSS JOIN c) GROUP BY 1""")
def _(v):
    spots = points(v)
    found = rg.lookup_region(spots, v.regions)
    return q.missing_regions(spots, found, v.regions).select("point_id", "nearest_name", r6("distance_km").alias("distance_km"))


@query("j11_crop_poles", """WITH b AS (SELECT route_id, CAST(floor(route_id / 8e0) AS BIGINT) AS region_id, min(e) - 200 AS x0, max(e) + 200 AS x1, min(n) - 200 AS y0, max(n) + 200 AS y1 FROM v_tracks GROUP BY 1, 2)
 SELECT b.route_id, p.idx FROM v_base p JOIN b ON b.region_id = p.region_id AND p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1""")
def _(v):
    poles = v.tracks.withColumn("region_id", F.floor(F.col("route_id") / 8))
    return rg.crop_poles(v.base.drop("route_id"), poles).select("route_id", "idx")


@query("j11_crop_edges", """WITH b AS (SELECT route_id, CAST(floor(route_id / 8e0) AS BIGINT) AS region_id, min(e) - 20 AS x0, max(e) + 20 AS x1, min(n) + 300 AS y0, max(n) AS y1 FROM v_tracks WHERE page < 4 GROUP BY 1, 2)
 SELECT b.route_id, p.edge_id FROM v_base_edges p JOIN (SELECT route_id, region_id, x0, x1, y0 - 320 AS y0, y1 + 20 AS y1 FROM b) b ON b.region_id = p.region_id AND p.ax BETWEEN x0 AND x1 AND p.ay BETWEEN y0 AND y1 AND p.bx BETWEEN x0 AND x1 AND p."by" BETWEEN y0 AND y1""")
def _(v):
    poles = v.tracks.where("page < 4").withColumn("region_id", F.floor(F.col("route_id") / 8))
    return rg.crop_edges(v.base_edges, poles, margin=20.0).select("route_id", "edge_id")


@query("j8_snap_adjacency", """WITH ends AS (SELECT region_id, edge_id, 0 AS side, ax AS x, ay AS y FROM v_base_edges UNION ALL SELECT region_id, edge_id, 1, bx, "by" FROM v_base_edges),
 c AS (SELECT e.*, p.idx, p.x AS px, p.y AS py, row_number() OVER (PARTITION BY e.region_id, edge_id, side ORDER BY sqrt(pow(p.x - e.x, 2) + pow(p.y - e.y, 2)), idx) AS k FROM ends e JOIN v_base p ON p.region_id = e.region_id AND sqrt(pow(p.x - e.x, 2) + pow(p.y - e.y, 2)) <= 3),
 m AS (SELECT a.region_id, a.idx AS u, b.idx AS v, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) AS w FROM c a JOIN c b ON a.region_id = b.region_id AND a.edge_id = b.edge_id AND a.side = 0 AND b.side = 1 AND a.k = 1 AND b.k = 1 AND a.idx <> b.idx)
 SELECT DISTINCT region_id, u, v, round(w, 6) AS w FROM (SELECT * FROM m UNION ALL SELECT region_id, v, u, w FROM m)""")
def _(v):
    return rounded(rg.snap_adjacency(v.base, v.base_edges), "w")


CAT = "SELECT region_id, concat(name, '-b') AS name, min_lat - 0.001e0 AS min_lat, max_lat, min_lon, max_lon, (region_id % 5) * 700 + 900 AS uploaded_at FROM v_regions WHERE max_lat < -27.603e0"


def incoming(v):
    return v.regions.where("max_lat < -27.603e0").selectExpr("region_id", "concat(name, '-b') AS name", "min_lat - 0.001e0 AS min_lat", "max_lat", "min_lon", "max_lon", "(region_id % 5) * 700 + 900 AS uploaded_at")


@query("s7_upsert_regions", f"""WITH a AS (SELECT *, 0 AS k FROM v_regions), b AS (SELECT region_id, name, min_lat, max_lat, min_lon, max_lon, uploaded_at, 1 AS k FROM ({CAT}))
 SELECT region_id, name, round(min_lat, 7) AS min_lat, uploaded_at FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY uploaded_at DESC, k DESC) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE r = 1""")
def _(v):
    return rg.upsert_regions(v.regions, incoming(v)).select("region_id", "name", r6("min_lat", 7).alias("min_lat"), "uploaded_at")


@query("s8_delete_regions", f"SELECT region_id, name FROM v_regions WHERE region_id NOT IN (SELECT region_id FROM ({CAT}))")
def _(v):
    return rg.delete_regions(v.regions, incoming(v)).select("region_id", "name")


@query("s9_list_regions", "SELECT region_id, name, uploaded_at, round(min_lat, 7) AS min_lat, round(max_lat, 7) AS max_lat, min_lon, round(max_lon, 7) AS max_lon FROM v_regions")
def _(v):
    return rounded(rg.list_regions(v.regions), "min_lat", "max_lat", "max_lon", places=7)


@query("j18_merge_catalogues", f"""WITH b AS ({CAT}), a AS (SELECT * FROM v_regions WHERE min_lon < 0 AND max_lon > -48.6e0 + 5e-4)
 SELECT coalesce(a.region_id, b.region_id) AS region_id, coalesce(b.name, a.name) AS name, greatest(a.uploaded_at, b.uploaded_at) AS uploaded_at,
  CASE WHEN a.region_id IS NOT NULL AND b.region_id IS NOT NULL THEN 'local+shared' WHEN b.region_id IS NOT NULL THEN 'shared' ELSE 'local' END AS origin FROM a FULL JOIN b ON a.region_id = b.region_id""")
def _(v):
    local = v.regions.where("max_lon > -48.6e0 + 5e-4")
    return rg.merge_catalogues(local, incoming(v))
