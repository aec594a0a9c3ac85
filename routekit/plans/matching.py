"""Spatial matching and label association over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from routekit.operators import association as asn
from routekit.operators import linework as lw
from routekit.operators import matching as mt
from routekit.operators import quality as ql
from routekit.operators.core import radius_pairs
from routekit.plans.geometry import ARC, HITS, TAPPED, arcs, hits, hits_sql, tapped
from routekit.plans.registry import query, r6, rounded
from routekit.plans.scalars import hav_sql


def greedy_sql(cand: str, by: str, order: str = "cost, lid, rid", name: str = "gr") -> str:
    """CTEs name(by, lid, rid, cost): pairs of `cand` taken in order, each end at most once."""
    return f"""{name}0 AS (SELECT {by}, list_reduce(list([{{'l': lid, 'r': rid, 'c': cost}}] ORDER BY {order}),
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda p: p.l = x[1].l OR p.r = x[1].r)) > 0 THEN acc ELSE list_concat(acc, x) END) AS ps FROM {cand} GROUP BY {by}),
 {name} AS (SELECT {by}, u.l AS lid, u.r AS rid, u.c AS cost FROM (SELECT {by}, unnest(ps) AS u FROM {name}0))"""


D2 = "sqrt(pow({a}.x - {b}.x, 2) + pow({a}.y - {b}.y, 2))"
MK = """mk AS (SELECT route_id, mark_id, page, min(x) AS x, min(y) AS y FROM v_markers GROUP BY ALL), pl AS (SELECT route_id, page, row_id, min(number) AS number, min(x) AS x, min(y) AS y FROM v_poles GROUP BY ALL)"""


def markers(v):
    return v.markers.groupBy("route_id", "mark_id", "page").agg(F.min("x").alias("x"), F.min("y").alias("y"))


def messy_poles(v):
    return v.poles.groupBy("route_id", "page", "row_id").agg(F.min("number").alias("number"), F.min("x").alias("x"), F.min("y").alias("y"))


def messy_symbols(v):
    return messy_poles(v).withColumnRenamed("row_id", "sym_id")


@query("j1_assign_1to1", f"""WITH {MK}, ca AS (SELECT mk.route_id, mk.page, mark_id AS lid, row_id AS rid, {D2.format(a='mk', b='pl')} AS cost FROM mk JOIN pl ON mk.route_id = pl.route_id AND mk.page = pl.page AND {D2.format(a='mk', b='pl')} <= 150),
 {greedy_sql('ca', 'route_id, page')} SELECT mk.route_id, mk.page, mk.mark_id, round(coalesce(pl.x, mk.x), 6) AS x, round(coalesce(pl.y, mk.y), 6) AS y, pl.x IS NOT NULL AS snapped FROM mk LEFT JOIN gr ON gr.route_id = mk.route_id AND gr.page = mk.page AND gr.lid = mark_id
 LEFT JOIN pl ON pl.route_id = gr.route_id AND pl.page = gr.page AND pl.row_id = gr.rid""")
def _(v):
    return rounded(mt.snap_markers(markers(v), messy_symbols(v)), "x", "y")


@query("j2_attach_nearest_below", f"""WITH {MK}, it AS (SELECT route_id, page, item_id, x + coalesce(width, 0) / 2 AS ax, y, trim(regexp_replace(regexp_extract(str, '\\b\\d{{1,3}}\\s*-\\s*\\d{{1,4}}\\b(?:\\s*\\([^)]{{0,24}}\\))?'), '\\s+', ' ', 'g')) AS ty FROM v_items),
 c AS (SELECT pl.*, ty, row_number() OVER (PARTITION BY pl.route_id, pl.page, row_id ORDER BY sqrt(pow(ax - pl.x, 2) + pow(it.y - pl.y, 2)), item_id) AS k FROM pl JOIN it ON it.route_id = pl.route_id AND it.page = pl.page AND it.y - pl.y BETWEEN 1 AND 150 AND abs(ax - pl.x) <= 130 AND ty <> '')
 SELECT pl.route_id, pl.page, pl.row_id, c.ty AS pole_type FROM pl LEFT JOIN (SELECT * FROM c WHERE k = 1) c ON c.route_id = pl.route_id AND c.page = pl.page AND c.row_id = pl.row_id""")
def _(v):
    return mt.attach_nearest_below(messy_poles(v), v.items).select("route_id", "page", "row_id", "pole_type")


@query("j3_correlate_text", f"""WITH {MK}, it AS (SELECT route_id, page, item_id, min(x) AS x, min(y) AS y FROM v_items GROUP BY ALL),
 c AS (SELECT it.route_id, it.page, it.item_id, concat('L', number) AS run_layer, row_number() OVER (PARTITION BY it.route_id, it.page, it.item_id ORDER BY {D2.format(a='it', b='pl')}, row_id) AS k FROM it JOIN pl ON it.route_id = pl.route_id AND it.page = pl.page AND {D2.format(a='it', b='pl')} < 40)
 SELECT it.route_id, it.page, it.item_id, run_layer FROM it LEFT JOIN (SELECT * FROM c WHERE k = 1) c USING (route_id, page, item_id)""")
def _(v):
    items = v.items.groupBy("route_id", "page", "item_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    runs = messy_poles(v).select("route_id", "page", F.col("row_id").alias("run_id"), F.concat(F.lit("L"), F.col("number").cast("string")).alias("layer"), "x", "y")
    return mt.correlate_text(items, runs, tol=40.0).select("route_id", "page", "item_id", "run_layer")


LP = "lp AS (SELECT route_id, page, item_id, CAST(replace(str, ',', '.') AS DOUBLE) AS metres, x + coalesce(width, 0) / 2 AS x, y FROM v_labels)"
SG = """ps AS (SELECT a.route_id, b.page, a.number AS lo, b.number AS hi, a.page <> b.page AS cross_, CASE WHEN a.page <> b.page THEN b.x ELSE a.x END AS ax, CASE WHEN a.page <> b.page THEN b.y ELSE a.y END AS ay, b.x AS bx, b.y AS by_,
  sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS drawn FROM v_tracks a JOIN v_tracks b ON b.route_id = a.route_id AND b.number = a.number + 1)"""


def gap_expr(px, py, ax="ax", ay="ay", bx="bx", by="by_"):
    l2 = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    t = f"CASE WHEN {l2} = 0 THEN 0 ELSE greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {l2})) END"
    return f"sqrt(pow({px} - ({ax} + ({t}) * ({bx} - {ax})), 2) + pow({py} - ({ay} + ({t}) * ({by} - {ay})), 2))", t


GE, TE = gap_expr("l.x", "l.y")


def cand_sql(labels: str = "lp", cap: float = 120, max_gap: float = 120, name: str = "ca", segs: str = "ps") -> str:
    return f"""{name}0 AS (SELECT s.route_id, s.lo AS lid, l.item_id AS rid, s.hi, l.metres, {GE} AS gap, {TE} AS t, CASE WHEN cross_ THEN NULL ELSE drawn * 0.5e0 / metres END AS ratio FROM {segs} s JOIN {labels} l ON l.route_id = s.route_id AND l.page = s.page),
 {name} AS (SELECT *, gap + CASE WHEN ratio > 0 THEN 35 * abs(ln(ratio)) ELSE 0 END AS cost FROM {name}0 WHERE gap <= {max_gap} AND (ratio IS NULL OR ratio BETWEEN 0.35e0 AND 2.5e0 OR gap < 55) AND gap + CASE WHEN ratio > 0 THEN 35 * abs(ln(ratio)) ELSE 0 END <= {cap})"""


def scales(v):
    return v.tracks.select("route_id", "page").distinct().withColumn("scale", F.lit(0.5))


J5 = f"{LP}, {SG}, {cand_sql()}, {greedy_sql('ca', 'route_id')}, j5 AS (SELECT ps.route_id, ps.lo, ps.hi, lp.metres AS meters, gr.rid AS item_id FROM ps LEFT JOIN gr ON gr.route_id = ps.route_id AND gr.lid = ps.lo LEFT JOIN lp ON lp.route_id = gr.route_id AND lp.item_id = gr.rid)"


@query("j5_assign_labels", f"WITH {J5} SELECT * FROM j5")
def _(v):
    return asn.assign_labels_to_spans(v.tracks, v.labels, scales(v)).drop("source")


KNN = """kn AS (SELECT * FROM (SELECT l.route_id, l.page, l.item_id, l.x, l.y, l.metres, p.number, p.x AS px, p.y AS py, sqrt(pow(p.x - l.x, 2) + pow(p.y - l.y, 2)) AS d, row_number() OVER (PARTITION BY l.route_id, l.item_id ORDER BY sqrt(pow(p.x - l.x, 2) + pow(p.y - l.y, 2)), p.number) AS rank
   FROM lp l JOIN v_tracks p ON p.route_id = l.route_id AND p.page = l.page) WHERE rank <= 4)"""
G6, _ = gap_expr("a.x", "a.y", "a.px", "a.py", "b.px", "b.py")
J6 = f"""{LP}, {KNN}, ch AS (SELECT a.route_id, a.item_id, a.metres, a.number AS lo, b.number AS hi, {G6} AS gap, pow(b.px - a.px, 2) + pow(b.py - a.py, 2) AS l2, ((a.x - a.px) * (b.px - a.px) + (a.y - a.py) * (b.py - a.py)) / (pow(b.px - a.px, 2) + pow(b.py - a.py, 2)) AS t FROM kn a JOIN kn b ON a.route_id = b.route_id AND a.item_id = b.item_id AND a.number < b.number),
 c2 AS (SELECT *, sqrt(l2) * 0.5e0 / metres AS ratio, gap + 35 * abs(ln(sqrt(l2) * 0.5e0 / metres)) AS score FROM ch WHERE t BETWEEN 0.1e0 AND 0.9e0 AND gap <= 30), c3 AS (SELECT *, row_number() OVER (PARTITION BY route_id, item_id ORDER BY score, lo, hi) AS k FROM c2 WHERE ratio BETWEEN 0.5e0 AND 2 AND score <= 80),
 c4 AS (SELECT * FROM c3 WHERE k = 1 AND hi - lo > 1 AND hi - lo <= 6), j6 AS (SELECT route_id, lo, hi, metres AS meters, item_id FROM (SELECT *, row_number() OVER (PARTITION BY route_id, lo, hi ORDER BY metres, item_id) AS z FROM c4) WHERE z = 1)"""


@query("o5_nearest_poles", f"WITH {LP}, {KNN} SELECT route_id, page, item_id, number, round(d, 6) AS d, rank FROM kn")
def _(v):
    return rounded(mt.nearest_poles(asn.label_points(v.labels), v.tracks), "d")


@query("j6_infer_nonconsecutive", f"WITH {J6} SELECT * FROM j6")
def _(v):
    return asn.infer_nonconsecutive(v.tracks, v.labels, scales(v)).drop("source")


J7 = f"""{J6}, lr AS (SELECT * FROM lp WHERE item_id NOT IN (SELECT item_id FROM j6)), {SG}, {cand_sql('lr')}, {greedy_sql('ca', 'route_id')},
 sq AS (SELECT ps.route_id, ps.lo, ps.hi, lr.metres AS meters, CASE WHEN lr.metres IS NOT NULL THEN 'legacy-midpoint' END AS source FROM ps LEFT JOIN gr ON gr.route_id = ps.route_id AND gr.lid = ps.lo LEFT JOIN lr ON lr.route_id = gr.route_id AND lr.item_id = gr.rid),
 j7 AS (SELECT * FROM sq UNION ALL SELECT route_id, lo, hi, meters, 'inferred-label' FROM j6 WHERE (route_id, lo, hi) NOT IN (SELECT (route_id, lo, hi) FROM sq))"""


@query("j7_merge_spans", f"WITH {J7} SELECT j.route_id, j.lo, j.hi, coalesce(o.v, meters) AS meters, CASE WHEN o.v IS NOT NULL THEN 'override' ELSE j.source END AS source FROM j7 j LEFT JOIN (SELECT route_id, number, v FROM v_tracks WHERE source = 'signup') o ON o.route_id = j.route_id AND o.number = j.lo AND j.hi = j.lo + 1")
def _(v):
    overrides = v.tracks.where("source = 'signup'").selectExpr("route_id", "number AS lo", "number + 1 AS hi", "v AS meters")
    return asn.associate(v.tracks, v.labels, scales(v), overrides)


G7, T7 = gap_expr("o.x", "o.y")
W6 = f"""{J5}, us AS (SELECT ps.route_id, ps.page, ps.lo, ps.ax, ps.ay, ps.bx, ps.by_, ps.drawn, j5.item_id, lp.x, lp.y, lp.metres, ps.lo - row_number() OVER (PARTITION BY ps.route_id, ps.page ORDER BY ps.lo) AS g FROM ps JOIN j5 USING (route_id, lo) JOIN lp ON lp.route_id = ps.route_id AND lp.item_id = j5.item_id WHERE NOT cross_),
 rn AS (SELECT *, row_number() OVER w AS k, sum(drawn) OVER w - drawn AS c0 FROM us WINDOW w AS (PARTITION BY route_id, page, g ORDER BY lo)),
 al AS (SELECT o.route_id, o.page, o.g, o.item_id, arg_min(s.c0 + ({T7.replace('ax', 's.ax').replace('ay', 's.ay').replace('bx', 's.bx').replace('by_', 's.by_')}) * s.drawn, [({G7.replace('ax', 's.ax').replace('ay', 's.ay').replace('bx', 's.bx').replace('by_', 's.by_')}), s.lo]) AS along FROM rn o JOIN rn s ON s.route_id = o.route_id AND s.page = o.page AND s.g = o.g GROUP BY ALL),
 o2 AS (SELECT al.*, rn.x AS nx, rn.y AS ny, rn.metres AS nm, row_number() OVER (PARTITION BY al.route_id, al.page, al.g ORDER BY along, al.item_id) AS k FROM al JOIN rn USING (route_id, page, g, item_id)),
 mv AS (SELECT rn.*, o2.item_id AS ni, nm, {gap_expr('rn.x', 'rn.y', 'rn.ax', 'rn.ay', 'rn.bx', 'rn.by_')[0]} AS og, {gap_expr('nx', 'ny', 'rn.ax', 'rn.ay', 'rn.bx', 'rn.by_')[0]} AS ng FROM rn JOIN o2 USING (route_id, page, g, k)),
 bt AS (SELECT *, sum(ng) OVER (PARTITION BY route_id, page, g) < sum(og) OVER (PARTITION BY route_id, page, g) AS rm FROM mv)"""


@query("w6_street_order_remap", f"WITH {W6} SELECT j5.route_id, j5.lo, j5.hi, CASE WHEN rm THEN nm ELSE j5.meters END AS meters, CASE WHEN rm THEN ni ELSE j5.item_id END AS item_id, coalesce(rm, false) AS remapped FROM j5 LEFT JOIN bt USING (route_id, lo)")
def _(v):
    spans = asn.assign_labels_to_spans(v.tracks, v.labels, scales(v))
    return asn.street_order_remap(spans, v.labels, v.tracks)


@query("w7_monotonic_match")
def _(v):
    return asn.monotonic_match(v.tracks, v.labels, scales(v))


@query("j9_radius_join", "SELECT b.region_id, b.idx, t.row_id, round(sqrt(pow(b.x - t.e, 2) + pow(b.y - t.n, 2)), 6) AS d FROM v_base b JOIN v_tracks t ON CAST(floor(t.route_id / 8e0) AS BIGINT) = b.region_id AND sqrt(pow(b.x - t.e, 2) + pow(b.y - t.n, 2)) <= 30")
def _(v):
    left = v.base.selectExpr("region_id", "idx AS lid", "x AS lx", "y AS ly")
    right = v.tracks.selectExpr("CAST(floor(route_id / 8) AS BIGINT) AS region_id", "row_id AS rid", "e AS rx", "n AS ry")
    return radius_pairs(left, right, 30.0, ["region_id"]).select("region_id", F.col("lid").alias("idx"), F.col("rid").alias("row_id"), r6("d").alias("d"))


TR = "tr AS (SELECT route_id, CAST(floor(route_id / 8e0) AS BIGINT) AS region_id, number, e + 6 AS e, n - 4 AS n, row_id, source FROM v_tracks)"


def regioned(v):
    return v.tracks.select("route_id", F.floor(F.col("route_id") / 8).alias("region_id"), "number", (F.col("e") + 6).alias("e"), (F.col("n") - 4).alias("n"), "row_id", "source")


ADJ = "ad AS (SELECT a.region_id, a.idx AS u, b.idx AS v, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS w FROM v_base a JOIN v_base b ON b.region_id = a.region_id AND b.route_id = a.route_id AND abs(b.idx - a.idx) IN (1, 3))"


def base_adj(v):
    a = v.base.selectExpr("region_id", "route_id", "idx AS u", "x AS ux", "y AS uy")
    b = v.base.select("region_id", "route_id", F.col("idx").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.explode(F.array(*[F.col("idx") + i for i in (-3, -1, 1, 3)])).alias("u"))
    w = F.sqrt(F.pow(F.col("ux") - F.col("vx"), F.lit(2.0)) + F.pow(F.col("uy") - F.col("vy"), F.lit(2.0)))
    return a.join(b, ["region_id", "route_id", "u"]).select("region_id", "u", "v", w.alias("w"))


@query("j12_lift_topology", f"""WITH {TR}, ca AS (SELECT tr.route_id, tr.number AS lid, b.idx AS rid, sqrt(pow(tr.e - b.x, 2) + pow(tr.n - b.y, 2)) AS cost FROM tr JOIN v_base b ON b.region_id = tr.region_id AND sqrt(pow(tr.e - b.x, 2) + pow(tr.n - b.y, 2)) <= 25),
 {greedy_sql('ca', 'route_id', 'lid, cost, rid')}, {ADJ} SELECT DISTINCT a.route_id, a.lid AS number, b.lid AS neighbour FROM gr a JOIN ad ON ad.u = a.rid JOIN gr b ON b.route_id = a.route_id AND b.rid = ad.v WHERE a.lid <> b.lid""")
def _(v):
    return mt.lift_topology(regioned(v), v.base, base_adj(v))


@query("j13_prune_candidates", f"""WITH {TR}, c AS (SELECT tr.route_id, tr.number, b.idx, sqrt(pow(tr.e - b.x, 2) + pow(tr.n - b.y, 2)) AS d, row_number() OVER (PARTITION BY tr.route_id, tr.number ORDER BY sqrt(pow(tr.e - b.x, 2) + pow(tr.n - b.y, 2)), b.idx) AS rank, count(*) OVER (PARTITION BY tr.route_id, tr.number) AS unpruned
 FROM tr JOIN v_base b ON b.region_id = tr.region_id AND abs(b.x - tr.e) <= 20 * (1 + 0.25e0 * (number % 7)) AND abs(b.y - tr.n) <= 20 * (1 + 0.25e0 * (number % 7))) SELECT route_id, number, idx, round(d, 6) AS d, rank, unpruned FROM c WHERE rank <= 30""")
def _(v):
    predicted = regioned(v).withColumn("hops", F.col("number") % 7)
    return rounded(mt.prune_candidates(predicted, v.base, 20.0), "d")


@query("j14_best_neighbour", f"""WITH {TR}, {ADJ}, c AS (SELECT s.route_id, s.lo AS number, ad.v, abs(ad.w - s.meters) AS delta, row_number() OVER (PARTITION BY s.route_id, s.lo ORDER BY abs(ad.w - s.meters), ad.v) AS k FROM v_spans s JOIN tr ON tr.route_id = s.route_id AND tr.number = s.lo JOIN ad ON ad.region_id = tr.region_id AND ad.u = tr.row_id
   WHERE abs(ad.w - s.meters) <= 10 AND NOT EXISTS (SELECT 1 FROM tr x WHERE x.route_id = s.route_id AND x.row_id = ad.v AND x.source = 'click')) SELECT route_id, number, v, round(delta, 6) AS delta FROM c WHERE k = 1""")
def _(v):
    poles = regioned(v)
    frontier = poles.join(v.spans.selectExpr("route_id", "lo AS number", "meters AS label").where("label IS NOT NULL"), ["route_id", "number"]).withColumnRenamed("row_id", "u")
    claimed = poles.where("source = 'click'").selectExpr("route_id", "row_id AS v")
    return rounded(mt.best_neighbour_by_span(frontier, base_adj(v), claimed, 10.0), "delta")


@query("j17_detect_gaps", """WITH vx AS (SELECT route_id, page, path_id * 8 + CAST(floor(seq / 4e0) AS BIGINT) AS path_id, ax AS x, ay AS y FROM v_segs), pr AS (SELECT a.route_id, a.page, a.number AS lo, b.number AS hi, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM v_tracks a JOIN v_tracks b ON b.route_id = a.route_id AND b.number = a.number + 1)
 SELECT route_id, lo, hi FROM pr WHERE NOT EXISTS (SELECT 1 FROM vx p JOIN vx q ON q.route_id = p.route_id AND q.page = p.page AND q.path_id = p.path_id WHERE p.route_id = pr.route_id AND p.page = pr.page AND sqrt(pow(p.x - x0, 2) + pow(p.y - y0, 2)) < 30 AND sqrt(pow(q.x - x1, 2) + pow(q.y - y1, 2)) < 30)
 AND NOT EXISTS (SELECT 1 FROM v_spans s WHERE s.route_id = pr.route_id AND s.lo = pr.lo AND s.meters > 30)""")
def _(v):
    vertices = v.segs.selectExpr("route_id", "page", "path_id * 8 + CAST(floor(seq / 4) AS BIGINT) AS path_id", "ax AS x", "ay AS y")
    return mt.detect_gaps(v.tracks, v.spans.where("meters > 30"), vertices, radius=30.0)


DP = "dp AS (SELECT route_id, number, page, x, y, row_id FROM (SELECT *, row_number() OVER (PARTITION BY route_id, number ORDER BY CASE WHEN page = 2 THEN 1 ELSE 0 END DESC, page DESC, row_id DESC, x DESC) AS k FROM v_poles) WHERE k = 1)"


def deduped(v):
    pages = v.poles.where("page = 2").select("route_id", "page").distinct()
    return asn.dedupe_poles(v.poles, pages)


@query("d1_dedupe_poles", f"WITH {DP} SELECT * FROM dp")
def _(v):
    return deduped(v).select("route_id", "number", "page", "x", "y", "row_id")


JU = f"""{DP}, lg AS (SELECT *, lag(number) OVER w AS pn, lag(x) OVER w AS px, lag(y) OVER w AS py FROM dp WINDOW w AS (PARTITION BY route_id ORDER BY number)), jm AS (SELECT * FROM lg WHERE number - pn > 1 AND sqrt(pow(x - px, 2) + pow(y - py, 2)) > 100),
 jn AS (SELECT j.route_id, j.number AS start, e.number AS junction, sqrt(pow(e.x - j.x, 2) + pow(e.y - j.y, 2)) AS d, row_number() OVER (PARTITION BY j.route_id, j.number ORDER BY sqrt(pow(e.x - j.x, 2) + pow(e.y - j.y, 2)), e.number) AS k FROM jm j JOIN dp e ON e.route_id = j.route_id AND e.number < j.number)"""


@query("j19_numbering_jumps", f"WITH {JU} SELECT route_id, start, junction, round(d, 6) AS junction_pt FROM jn WHERE k = 1")
def _(v):
    return rounded(mt.numbering_jumps(deduped(v)), "junction_pt")


@query("g18_route_topology", f"""WITH {JU}, b AS (SELECT dp.route_id, dp.number, coalesce(max(jn.start) FILTER (jn.start <= dp.number), 0) AS start FROM dp LEFT JOIN jn ON jn.route_id = dp.route_id AND k = 1 GROUP BY ALL)
 SELECT b.route_id, b.start, max(number) AS "end", any_value(junction) AS junction, count(*) AS n FROM b LEFT JOIN jn ON jn.route_id = b.route_id AND jn.start = b.start AND k = 1 GROUP BY b.route_id, b.start""")
def _(v):
    return mt.route_topology(deduped(v))


@query("j21_rescue_orphans", f"""WITH {LP}, {SG}, ac AS (SELECT route_id, lo FROM v_spans WHERE meters > 30), m AS (SELECT s.route_id, s.lo, l.item_id, l.metres, {GE} AS d FROM ps s JOIN lp l ON l.route_id = s.route_id AND l.page = s.page WHERE NOT cross_ AND {GE} <= 52),
 h AS (SELECT m.route_id, item_id, min(d) AS hd FROM m JOIN ac USING (route_id, lo) GROUP BY ALL), ca AS (SELECT m.route_id, m.lo AS lid, m.item_id AS rid, m.d AS cost FROM m LEFT JOIN h ON h.route_id = m.route_id AND h.item_id = m.item_id WHERE (m.route_id, m.lo) NOT IN (SELECT (route_id, lo) FROM ac)
   AND EXISTS (SELECT 1 FROM v_tracks t WHERE t.route_id = m.route_id AND t.source = 'view' AND t.number IN (m.lo, m.lo + 1)) AND coalesce(hd >= m.d * 0.88e0, true)), {greedy_sql('ca', 'route_id')}
 SELECT gr.route_id, lid AS lo, lid + 1 AS hi, lp.metres AS meters, rid AS item_id FROM gr JOIN lp ON lp.route_id = gr.route_id AND lp.item_id = gr.rid""")
def _(v):
    return asn.rescue_orphans(v.tracks, v.labels, v.spans.where("meters > 30"), v.tracks.where("source = 'view'"))


TURN = "SELECT route_id, CASE WHEN lo % 2 = 0 THEN hi ELSE lo END AS lo, CASE WHEN lo % 2 = 0 THEN lo ELSE hi END AS hi, meters, source FROM v_all_spans UNION ALL SELECT route_id, lo, hi, meters + 1, 'override' FROM v_spans WHERE meters > 30"


@query("j23_undirected_spans", f"""WITH t AS ({TURN}), r AS (SELECT *, CASE source WHEN 'override' THEN 4 WHEN 'bifurcation-main' THEN 3 WHEN 'inferred-label' THEN 2 WHEN 'legacy-midpoint' THEN 1 ELSE 0 END AS rk FROM t),
 w AS (SELECT route_id, least(lo, hi) AS lo, greatest(lo, hi) AS hi, meters, source, row_number() OVER (PARTITION BY route_id, least(lo, hi), greatest(lo, hi) ORDER BY rk DESC, meters IS NOT NULL DESC, meters DESC NULLS LAST) AS k FROM r) SELECT route_id, lo, hi, round(meters, 6) AS meters, source FROM w WHERE k = 1""")
def _(v):
    even = F.col("lo") % 2 == 0
    turned = v.all_spans.select("route_id", F.when(even, F.col("hi")).otherwise(F.col("lo")).alias("lo"), F.when(even, F.col("lo")).otherwise(F.col("hi")).alias("hi"), "meters", "source")
    extra = v.spans.where("meters > 30").select("route_id", "lo", "hi", (F.col("meters") + 1).alias("meters"), F.lit("override").alias("source"))
    return rounded(asn.undirected_spans(turned.unionByName(extra)), "meters")


@query("j23_outgoing", "SELECT route_id, lo AS src, string_agg(DISTINCT CAST(hi AS VARCHAR), ',' ORDER BY CAST(hi AS VARCHAR)) AS dsts FROM v_all_spans WHERE meters > 0 GROUP BY 1, 2")
def _(v):
    out = asn.outgoing(v.all_spans.where("meters > 0").selectExpr("route_id", "lo AS src", "hi AS dst"))
    return out.select("route_id", "src", F.array_join(F.array_sort(F.transform("dsts", lambda d: d.cast("string"))), ",").alias("dsts"))


@query("j24_widen_retry", f"""WITH {MK}, c AS (SELECT mk.route_id, mk.page, mark_id, row_id, {D2.format(a='mk', b='pl')} AS d, row_number() OVER (PARTITION BY mk.route_id, mk.page, mark_id ORDER BY {D2.format(a='mk', b='pl')}, row_id) AS k FROM mk JOIN pl ON mk.route_id = pl.route_id AND mk.page = pl.page)
 SELECT route_id, page, mark_id, row_id, round(d, 6) AS d, CASE WHEN d <= 60 THEN 60e0 ELSE 150e0 END AS radius FROM c WHERE k = 1 AND d <= 150""")
def _(v):
    out = mt.widen_retry(mt.side(markers(v), "l", "mark_id"), mt.side(messy_poles(v), "r", "row_id"))
    return out.select("route_id", "page", F.col("lid").alias("mark_id"), F.col("rid").alias("row_id"), r6("d").alias("d"), "radius")


@query("j25_fallback_positions", """WITH s AS (SELECT DISTINCT route_id FROM v_tracks WHERE v > 200) SELECT t.route_id, t.number, CASE WHEN s.route_id IS NULL THEN t.x + 3 ELSE t.x END AS x, CASE WHEN s.route_id IS NULL AND t.page < 4 THEN 'marker' WHEN s.route_id IS NULL THEN 'symbol' ELSE 'symbol' END AS source
 FROM (SELECT route_id, number, page, CASE WHEN page < 4 THEN x ELSE x - 3 END AS x FROM v_tracks) t LEFT JOIN s USING (route_id) WHERE page < 4 UNION ALL SELECT route_id, number, x, 'symbol' FROM v_tracks WHERE page >= 4""")
def _(v):
    marks = v.tracks.where("page < 4").select("route_id", "number", (F.col("x") + 3).alias("x"), "y")
    out = mt.fallback_positions(v.tracks.select("route_id", "number", "x", "y"), marks, v.tracks.where("v > 200"))
    return out.select("route_id", "number", "x", "source")


@query("j26_merge_candidates", "SELECT DISTINCT route_id, number, row_id AS rid FROM (SELECT route_id, number, row_id FROM v_poles WHERE page < 3 UNION ALL SELECT route_id, number, row_id FROM v_poles WHERE page > 1)")
def _(v):
    rows = v.poles.selectExpr("route_id", "number", "row_id AS rid", "page")
    return mt.merge_candidates(rows.where("page < 3").drop("page"), rows.where("page > 1").drop("page"))


@query("d2_thin_points", """WITH g AS (SELECT route_id, page, list_reduce(list([{'i': sym_id, 'x': x, 'y': y}] ORDER BY sym_id),
  lambda acc, q: CASE WHEN len(list_filter(acc, lambda p: sqrt(pow(p.x - q[1].x, 2) + pow(p.y - q[1].y, 2)) < 70)) > 0 THEN acc ELSE list_concat(acc, q) END) AS ps FROM v_symbols GROUP BY ALL)
 SELECT route_id, page, u.i AS point_id FROM (SELECT route_id, page, unnest(ps) AS u FROM g)""")
def _(v):
    points = v.symbols.select("route_id", "page", F.col("sym_id").alias("point_id"), "x", "y")
    return mt.thin_points(points, 70.0).select("route_id", "page", "point_id")


PH = "ph AS (SELECT route_id, lo, hi, meters, CASE WHEN hi = lo + 2 THEN 'inferred-label' ELSE source END AS source FROM v_all_spans WHERE route_id % 5 <> 0 UNION ALL SELECT route_id, lo, hi, meters, source FROM v_all_spans WHERE route_id % 5 = 0)"


@query("d4_drop_phantom_skips", f"""WITH {PH} SELECT route_id, lo, hi, round(meters, 6) AS meters, source FROM ph e WHERE NOT (hi = lo + 2 AND source = 'inferred-label' AND meters IS NOT NULL AND EXISTS (SELECT 1 FROM ph s WHERE s.route_id = e.route_id AND s.hi = s.lo + 1 AND s.lo IN (e.lo, e.lo + 1) AND abs(s.meters - e.meters) < 0.05e0))""")
def _(v):
    spans = v.all_spans.withColumn("source", F.when((F.col("hi") == F.col("lo") + 2) & (F.col("route_id") % 5 != 0), "inferred-label").otherwise(F.col("source")))
    return rounded(asn.drop_phantom_skips(spans), "meters")


EQ = "eq AS (SELECT route_id, lo, hi, meters, CASE WHEN hi = lo + 1 AND lo % 4 = 0 THEN 'override' ELSE source END AS source FROM v_all_spans)"


def ranked_spans(v):
    return v.all_spans.withColumn("source", F.when((F.col("hi") == F.col("lo") + 1) & (F.col("lo") % 4 == 0), "override").otherwise(F.col("source")))


@query("d5_equal_at_junction", f"""WITH {EQ}, r AS (SELECT *, CASE source WHEN 'override' THEN 4 WHEN 'bifurcation-main' THEN 3 WHEN 'inferred-label' THEN 2 WHEN 'legacy-midpoint' THEN 1 ELSE 0 END AS rk FROM eq),
 z AS (SELECT w.*, EXISTS (SELECT 1 FROM r s WHERE s.route_id = w.route_id AND s.rk >= 3 AND s.rk > w.rk AND abs(s.meters - w.meters) <= 0.25e0 AND (s.lo IN (w.lo, w.hi) OR s.hi IN (w.lo, w.hi))) AND w.hi > w.lo + 1 AND w.meters > 0 AS gone FROM r w)
 SELECT route_id, lo, hi, round(CASE WHEN NOT gone THEN meters END, 6) AS meters, CASE WHEN gone THEN 'phantom-dedup-cleared' ELSE source END AS source FROM z""")
def _(v):
    return rounded(asn.dedup_equal_at_junction(ranked_spans(v)), "meters")


WR = "wr AS (SELECT route_id, lo, hi, CASE WHEN meters IS NULL THEN NULL ELSE round(meters) END AS meters, CASE WHEN lo % 3 = 0 THEN 'window-refine' WHEN lo % 3 = 1 THEN 'jumpback-refill' ELSE source END AS source FROM v_spans)"


def refined(v):
    source = F.when(F.col("lo") % 3 == 0, "window-refine").when(F.col("lo") % 3 == 1, "jumpback-refill").otherwise(F.col("source"))
    return v.spans.withColumns({"meters": F.round("meters"), "source": source})


@query("d6_demote_duplicates", f"""WITH {WR} SELECT route_id, lo, hi, meters, CASE WHEN source = 'window-refine' AND meters > 0 AND EXISTS (SELECT 1 FROM wr o WHERE o.route_id = w.route_id AND abs(o.lo - w.lo) = 1 AND abs(o.meters - w.meters) < 0.05e0 AND o.source NOT IN ('jumpback-refill', 'inferred-label'))
 THEN 'window-refine-duplicate' ELSE source END AS source FROM wr w""")
def _(v):
    return asn.demote_duplicates(refined(v))


@query("d6_demote_by_label")
def _(v):
    labels = v.labels.withColumn("str", F.regexp_replace("str", ",.*", ",0"))
    return asn.demote_duplicates(refined(v), labels, v.tracks)


@query("d7_drop_conflicting", f"""WITH cl AS (SELECT * FROM v_spans WHERE source = 'inferred-label' AND meters > 0) SELECT route_id, lo, hi, round(meters, 6) AS meters, source FROM v_all_spans s WHERE NOT (hi > lo + 1 AND meters IS NOT NULL AND EXISTS (SELECT 1 FROM cl c WHERE c.route_id = s.route_id AND abs(c.meters - s.meters) <= 0.05e0 AND NOT (c.lo = s.lo AND c.hi = s.hi)))""")
def _(v):
    return rounded(asn.drop_conflicting(v.all_spans, v.spans.where("source = 'inferred-label' AND meters > 0")), "meters")


JB = """jb AS (SELECT DISTINCT j.route_id, j.lo, j.hi FROM v_all_spans j JOIN v_all_spans s ON s.route_id = j.route_id AND s.lo = j.lo AND s.hi = j.lo + 1 AND s.meters > 0 JOIN v_tracks a ON a.route_id = j.route_id AND a.number = j.hi WHERE j.meters > 0 AND j.hi - j.lo BETWEEN 4 AND 6),
 it AS (SELECT DISTINCT route_id, hi - 1 AS lo, hi FROM jb), af AS (SELECT DISTINCT jb.route_id, jb.hi AS lo, jb.hi + 1 AS hi FROM jb JOIN v_tracks t ON t.route_id = jb.route_id AND t.number = jb.hi + 1),
 su AS (SELECT s.route_id, s.lo, s.hi, CASE WHEN it.lo IS NULL AND af.lo IS NULL THEN s.meters END AS meters, CASE WHEN it.lo IS NOT NULL THEN 'jumpback-suppressed' WHEN af.lo IS NOT NULL AND s.meters IS NOT NULL THEN NULL ELSE s.source END AS source FROM v_all_spans s LEFT JOIN it USING (route_id, lo, hi) LEFT JOIN af USING (route_id, lo, hi)
  UNION ALL SELECT route_id, lo, hi, NULL, 'jumpback-suppressed' FROM it WHERE (route_id, lo, hi) NOT IN (SELECT (route_id, lo, hi) FROM v_all_spans))"""


@query("d8_suppress_jumpbacks", f"WITH {JB} SELECT route_id, lo, hi, round(meters, 6) AS meters, source FROM su")
def _(v):
    return rounded(asn.suppress_jumpbacks(v.all_spans, v.tracks), "meters")


@query("d9_shift_after_jumpback", f"""WITH {JB}, mv AS (SELECT s.route_id, s.hi AS lo, s.hi + 1 AS hi, max(o.meters) AS m FROM su s JOIN v_all_spans o USING (route_id, lo, hi) WHERE s.source = 'jumpback-suppressed' AND o.meters > 0 GROUP BY ALL),
 m2 AS (SELECT mv.* FROM mv JOIN su USING (route_id, lo, hi) WHERE su.source IS DISTINCT FROM 'jumpback-suppressed'), fn AS (SELECT su.route_id, su.lo, su.hi, coalesce(m2.m, su.meters) AS meters, CASE WHEN m2.m IS NOT NULL THEN 'jumpback-shift' ELSE su.source END AS source FROM su LEFT JOIN m2 USING (route_id, lo, hi))
 SELECT route_id, lo, hi, round(meters, 6) AS meters, source FROM fn f WHERE NOT (hi > lo + 1 AND meters IS NOT NULL AND EXISTS (SELECT 1 FROM m2 WHERE m2.route_id = f.route_id AND abs(m2.m - f.meters) <= 0.05e0))""")
def _(v):
    spans = v.all_spans
    return rounded(asn.shift_after_jumpback(spans, asn.suppress_jumpbacks(spans, v.tracks), v.tracks), "meters")


@query("d9_refill_spans", f"""WITH {J5}, hd AS (SELECT route_id, lo, hi, CASE WHEN lo % 3 = 0 THEN NULL ELSE meters END AS meters, CASE WHEN lo % 6 = 0 THEN 'jumpback-suppressed' WHEN lo % 3 = 0 THEN NULL ELSE 'legacy-midpoint' END AS source, CASE WHEN lo % 3 = 0 THEN NULL ELSE item_id END AS item_id FROM j5),
 em AS (SELECT route_id, lo FROM hd WHERE meters IS NULL AND coalesce(source NOT IN ('jumpback-suppressed'), true)), fr AS (SELECT * FROM lp WHERE item_id NOT IN (SELECT item_id FROM hd WHERE item_id IS NOT NULL)), p2 AS (SELECT ps.* FROM ps JOIN em USING (route_id, lo)),
 {cand_sql('fr', name='cb', segs='p2')}, {greedy_sql('cb', 'route_id', name='g2')}
 SELECT hd.route_id, hd.lo, hd.hi, coalesce(hd.meters, fr.metres) AS meters, CASE WHEN fr.metres IS NOT NULL THEN 'jumpback-refill' ELSE hd.source END AS source, coalesce(hd.item_id, g2.rid) AS item_id FROM hd LEFT JOIN g2 ON g2.route_id = hd.route_id AND g2.lid = hd.lo LEFT JOIN fr ON fr.route_id = g2.route_id AND fr.item_id = g2.rid""")
def _(v):
    spans = asn.assign_labels_to_spans(v.tracks, v.labels, scales(v))
    third = F.col("lo") % 3 == 0
    held = spans.select("route_id", "lo", "hi", F.when(~third, F.col("meters")).alias("meters"),
                        F.when(F.col("lo") % 6 == 0, "jumpback-suppressed").when(~third, "legacy-midpoint").alias("source"), F.when(~third, F.col("item_id")).alias("item_id"))
    return asn.refill_spans(held, v.labels, v.tracks, scales(v))


IJ = "ij AS (SELECT route_id, lo, hi, meters, CASE WHEN hi > lo + 1 AND source = 'legacy-midpoint' THEN 'inferred-label' ELSE source END AS source FROM v_all_spans)"
RC = """ac AS (SELECT route_id, lo FROM ij WHERE hi = lo + 1 AND meters > 0), rc AS (SELECT c.route_id, c.lo, c.hi FROM ij c WHERE c.source = 'inferred-label' AND c.hi > c.lo + 1 AND (SELECT count(*) FROM ac WHERE ac.route_id = c.route_id AND ac.lo >= c.lo AND ac.lo < c.hi) = c.hi - c.lo)"""


def inferred_jumps(v):
    return v.all_spans.withColumn("source", F.when((F.col("hi") > F.col("lo") + 1) & (F.col("source") == "legacy-midpoint"), "inferred-label").otherwise(F.col("source")))


@query("d10_drop_redundant_chords", f"WITH {IJ}, {RC} SELECT route_id, lo, hi, round(meters, 6) AS meters, source FROM ij WHERE (route_id, lo, hi) NOT IN (SELECT (route_id, lo, hi) FROM rc)")
def _(v):
    return rounded(asn.drop_redundant_chords(inferred_jumps(v)), "meters")


BR = """bk AS (SELECT route_id, hi AS rejoin FROM ij WHERE hi = lo + 1 AND meters IS NULL AND source IN ('jumpback-suppressed', 'bifurcation-cleared')),
 br AS (SELECT j.route_id, j.hi AS rejoin, max(j.lo) AS junction FROM ij j JOIN ac t ON t.route_id = j.route_id AND t.lo = j.lo JOIN bk ON bk.route_id = j.route_id AND bk.rejoin = j.hi WHERE j.meters > 0 AND j.hi > j.lo + 1 AND j.source IN ('inferred-label', 'bifurcation-main')
   AND (SELECT count(*) FROM ac WHERE ac.route_id = j.route_id AND ac.lo > j.lo AND ac.lo < j.hi - 1) = j.hi - j.lo - 2 GROUP BY ALL)"""


@query("d11_branch_returns", f"WITH {IJ}, {RC}, {BR} SELECT route_id, junction, rejoin, rejoin - 1 AS tip FROM br")
def _(v):
    return asn.branch_returns(inferred_jumps(v))


@query("d11_finalize_connections", f"""WITH {IJ}, {RC}, {BR}, co AS (SELECT route_id, lo AS src, hi AS dst, meters, source FROM ij WHERE hi = lo + 1 OR source = 'inferred-label'),
 dr AS (SELECT route_id, lo AS src, hi AS dst FROM ij WHERE meters IS NULL AND source IN ('jumpback-suppressed', 'bifurcation-cleared') UNION SELECT route_id, lo, hi FROM rc UNION SELECT route_id, rejoin - 1, rejoin FROM br
   UNION SELECT i.route_id, i.lo, i.hi FROM ij i JOIN br ON br.route_id = i.route_id AND br.rejoin = i.hi AND i.lo < br.junction WHERE i.source = 'inferred-label' AND i.meters > 0),
 mn AS (SELECT route_id, lo AS src, hi AS dst, meters, source FROM ij WHERE source = 'bifurcation-main' AND meters > 0 AND (route_id, lo, hi) NOT IN (SELECT (route_id, src, dst) FROM dr)), di AS (SELECT route_id, src + 1 AS src, dst FROM mn WHERE dst = src + 2),
 rj AS (SELECT br.route_id, junction AS src, rejoin AS dst, (SELECT max(meters) FROM ij WHERE ij.route_id = br.route_id AND ij.lo = junction AND ij.hi = rejoin) AS meters, 'inferred-label' AS source FROM br),
 ad AS (SELECT * FROM rj UNION ALL SELECT * FROM mn WHERE (route_id, src, dst) NOT IN (SELECT (route_id, src, dst) FROM rj)), fu AS (SELECT * FROM co UNION ALL SELECT * FROM ad WHERE (route_id, src, dst) NOT IN (SELECT (route_id, src, dst) FROM co))
 SELECT route_id, src, dst, round(meters, 6) AS meters, source FROM fu WHERE (route_id, src, dst) NOT IN (SELECT (route_id, src, dst) FROM dr UNION ALL SELECT (route_id, src, dst) FROM di)""")
def _(v):
    spans = inferred_jumps(v)
    conns = spans.where("hi = lo + 1 OR source = 'inferred-label'").selectExpr("route_id", "lo AS src", "hi AS dst", "meters", "source")
    return rounded(asn.finalize_connections(conns, spans), "meters")


@query("d12_complete_consecutive", f"""WITH co AS (SELECT route_id, lo AS src, hi AS dst, meters, 90e0 AS bearing, false AS cross_page, false AS implied FROM v_spans WHERE meters > 0 AND source <> 'inferred-label'),
 pr AS (SELECT a.route_id, a.number AS src, b.number AS dst, a.page <> b.page AS cp, {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS gm, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) * 0.5e0 AS dm, (degrees(atan2(b.x - a.x, b.y - a.y)) + 360) % 360 AS pb,
  (degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360) % 360 AS gb FROM v_tracks a JOIN v_tracks b ON b.route_id = a.route_id AND b.number = a.number + 1),
 im AS (SELECT pr.route_id, pr.src, pr.dst, CASE WHEN cp THEN gm ELSE coalesce(s.meters, dm) END AS meters, CASE WHEN cp THEN gb ELSE pb END AS bearing, cp AS cross_page, true AS implied FROM pr LEFT JOIN v_spans s ON s.route_id = pr.route_id AND s.lo = pr.src WHERE (pr.route_id, pr.src, pr.dst) NOT IN (SELECT (route_id, src, dst) FROM co))
 SELECT route_id, src, dst, round(meters, 6) AS meters, round(bearing, 5) AS bearing, cross_page, implied FROM (SELECT * FROM co UNION ALL SELECT * FROM im)""")
def _(v):
    conns = v.spans.where("meters > 0 AND source <> 'inferred-label'").selectExpr("route_id", "lo AS src", "hi AS dst", "meters", "90e0 AS bearing", "false AS cross_page")
    out = asn.complete_consecutive(conns, v.tracks, v.spans, scales(v))
    return rounded(rounded(out, "meters"), "bearing", places=5)


@query("d13_merge_split_labels")
def _(v):
    short = v.spans.withColumn("meters", F.when(F.col("lo") % 4 == 0, F.col("meters") / 3).otherwise(F.col("meters")))
    labels = v.labels.withColumn("str", F.when(F.col("item_id") % 3 == 0, "18,2").otherwise(F.col("str")))
    return rounded(asn.merge_split_labels(short, labels, v.tracks, scales(v)), "meters")


@query("d14_swap_at_junction")
def _(v):
    return rounded(asn.swap_at_junction(v.spans, v.labels, v.tracks, ql.label_degree(v.all_spans)), "meters")


def label_hits(v):
    points = asn.label_points(v.labels).withColumnRenamed("item_id", "point_id")
    return lw.nearest_on_cable(points, arcs(v)).withColumnRenamed("point_id", "item_id")


@query("d15_rehome_branch_arms")
def _(v):
    spans = v.all_spans
    crowded = v.tracks.withColumn("x", F.when(F.col("number") % 5 == 0, F.col("x") - 90).otherwise(F.col("x")))
    return rounded(asn.rehome_branch_arms(spans, v.labels, crowded, ql.label_degree(spans), label_hits(v)), "meters")


@query("d15_revert_bifurcations", """WITH tp AS (SELECT route_id, number, number + 1 AS nb FROM v_tracks WHERE source <> 'view' UNION ALL SELECT route_id, number, number - 1 FROM v_tracks WHERE source <> 'view' UNION ALL SELECT route_id, number, number + 4 FROM v_tracks WHERE source = 'error'),
 pn AS (SELECT route_id, number FROM tp GROUP BY ALL HAVING count(*) >= 2 AND bool_and(abs(nb - number) = 1)) SELECT s.route_id, lo, hi, round(CASE WHEN NOT (source = 'bifurcation-main' AND hi = lo + 2 AND pn.number IS NOT NULL) THEN meters END, 6) AS meters,
  CASE WHEN source = 'bifurcation-main' AND hi = lo + 2 AND pn.number IS NOT NULL THEN 'bifurcation-reverted' ELSE source END AS source FROM v_all_spans s LEFT JOIN pn ON pn.route_id = s.route_id AND pn.number = s.lo""")
def _(v):
    t = v.tracks.where("source <> 'view'")
    topo = (t.selectExpr("route_id", "number", "number + 1 AS neighbour").unionByName(t.selectExpr("route_id", "number", "number - 1 AS neighbour"))
            .unionByName(v.tracks.where("source = 'error'").selectExpr("route_id", "number", "number + 4 AS neighbour")))
    return rounded(asn.revert_false_bifurcations(v.all_spans, topo), "meters")
