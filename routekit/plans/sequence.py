"""Ordered-row operators over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from routekit.operators import fits as ft
from routekit.operators import linework as lw
from routekit.operators import quality as ql
from routekit.operators import sequence as sq
from routekit.plans.geometry import ARC, DRAWN, HITS, TAPPED, hits, hits_sql, tapped
from routekit.plans.registry import query, r6, rounded
from routekit.plans.scalars import hav_sql


@query("w1_consecutive", """SELECT route_id, number, row_id, lead(number) OVER w AS next_number, lead(page) OVER w AS next_page FROM (SELECT route_id, number, row_id, page, row_number() OVER (PARTITION BY route_id, number, row_id ORDER BY page) AS k FROM v_poles) WHERE k = 1
 WINDOW w AS (PARTITION BY route_id ORDER BY number, row_id)""")
def _(v):
    poles = v.poles.groupBy("route_id", "number", "row_id").agg(F.min_by(F.struct("page", "x", "y"), "page").alias("p")).select("route_id", "number", "row_id", "p.*")
    return sq.consecutive(poles).select("route_id", "number", "row_id", "next_number", "next_page")


@query("w4_number_runs", """WITH p AS (SELECT DISTINCT route_id, page, number FROM v_poles) SELECT route_id, page, number, min(number) OVER (PARTITION BY route_id, page, g) AS run FROM
 (SELECT *, number - row_number() OVER (PARTITION BY route_id, page ORDER BY number) AS g FROM p)""")
def _(v):
    return sq.number_runs(v.poles.select("route_id", "page", "number").distinct())


@query("w5_split_runs", """WITH q AS (SELECT route_id, number, page, source, CASE WHEN lag(page) OVER w IS NULL OR page <> lag(page) OVER w OR source = 'purchase' THEN number END AS o FROM v_tracks WINDOW w AS (PARTITION BY route_id ORDER BY number))
 SELECT route_id, number, max(o) OVER (PARTITION BY route_id ORDER BY number) AS run FROM q""")
def _(v):
    return sq.split_runs(v.tracks.select("route_id", "number", "page"), v.tracks.where("source = 'purchase'")).select("route_id", "number", "run")


CTX = """cx AS (SELECT r.*, n, CASE WHEN number BETWEEN 1 AND n THEN number WHEN number BETWEEN 86 AND 99 THEN CASE WHEN number - 40 <= n THEN number - 40 WHEN number - 38 <= n THEN number - 38 END END AS ctx FROM v_readings r JOIN (SELECT route_id, count(*) AS n FROM v_readings GROUP BY 1) USING (route_id)),
 cl AS (SELECT *, CASE WHEN number <= 9 AND ctx <= 9 AND number + 50 <= n THEN number + 50 ELSE ctx END AS label FROM cx),
 ed AS (SELECT route_id, page, arg_max(CASE WHEN ctx IS NULL THEN -1 ELSE ctx END, pos) AS lc, arg_min(CASE WHEN ctx IS NULL THEN -1 ELSE ctx END, pos) AS fc, arg_max(CASE WHEN ctx IS NULL THEN -1 ELSE label END, pos) AS ll, arg_min(CASE WHEN ctx IS NULL THEN -1 ELSE label END, pos) AS fl FROM cl GROUP BY ALL),
 nb AS (SELECT c.*, coalesce(last_value(c.ctx IGNORE NULLS) OVER b, nullif(p.lc, -1)) AS lo, coalesce(first_value(c.ctx IGNORE NULLS) OVER a, nullif(q.fc, -1)) AS hi,
   coalesce(last_value(c.label IGNORE NULLS) OVER b, nullif(p.ll, -1)) AS llo, coalesce(first_value(c.label IGNORE NULLS) OVER a, nullif(q.fl, -1)) AS lhi
   FROM cl c LEFT JOIN ed p ON p.route_id = c.route_id AND p.page = c.page - 1 LEFT JOIN ed q ON q.route_id = c.route_id AND q.page = c.page + 1
   WINDOW b AS (PARTITION BY c.route_id, c.page ORDER BY c.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY c.route_id, c.page ORDER BY c.pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


@query("w2_sandwich_fill", f"WITH {CTX} SELECT route_id, pos, number, coalesce(number, CASE WHEN hi - lo = 2 THEN lo + 1 END) AS filled FROM nb")
def _(v):
    return sq.sandwich_fill(v.readings).select("route_id", "pos", "number", "filled")


@query("w24_context_phrases", f"""WITH {CTX} SELECT route_id, pos, CASE WHEN lhi - llo = 2 THEN concat('entre os postes ', llo, ' e ', lhi) WHEN llo IS NOT NULL AND lhi IS NOT NULL THEN concat('entre os postes ', llo, ' e ', lhi, ' na folha')
 WHEN llo IS NOT NULL THEN concat('após o poste ', llo) WHEN lhi IS NOT NULL THEN concat('antes do poste ', lhi) ELSE 'sequência da rota na folha' END AS phrase FROM nb""")
def _(v):
    return sq.context_phrases(sq.context_numbers(v.readings)).select("route_id", "pos", "phrase")


@query("w25_label_around", f"""WITH {CTX}, ll AS (SELECT * FROM cl WHERE label IS NOT NULL), e2 AS (SELECT route_id, page, arg_max(label, pos) AS le, arg_min(label, pos) AS fe FROM ll GROUP BY ALL)
 SELECT c.route_id, c.pos, coalesce((SELECT bool_or(x.pos < c.pos) FROM ll x WHERE x.route_id = c.route_id AND x.page = c.page AND x.label = c.pos - 1), false) OR coalesce(p.le = c.pos - 1, false) AS seen_before,
  coalesce((SELECT bool_or(x.pos > c.pos) FROM ll x WHERE x.route_id = c.route_id AND x.page = c.page AND x.label = c.pos - 1), false) OR coalesce(q.fe = c.pos - 1, false) AS seen_after
 FROM cl c LEFT JOIN e2 p ON p.route_id = c.route_id AND p.page = c.page - 1 LEFT JOIN e2 q ON q.route_id = c.route_id AND q.page = c.page + 1""")
def _(v):
    return sq.has_label_around(sq.context_numbers(v.readings), F.col("pos") - 1).select("route_id", "pos", "seen_before", "seen_after")


@query("w3_repair_sequence")
def _(v):
    return sq.repair_sequence(v.readings).select("route_id", "pos", "number", "assigned", "action")


SPR = """pr AS (SELECT p.route_id, p.number AS lo, p.number + 1 AS hi, p.page AS pl, q.page AS ph, sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) AS chord, s.meters, s.source, p.source AS psrc FROM v_tracks p
  JOIN v_tracks q ON q.route_id = p.route_id AND q.number = p.number + 1 LEFT JOIN v_spans s ON s.route_id = p.route_id AND s.lo = p.number),
 ar AS (SELECT *, CASE WHEN psrc = 'purchase' THEN chord * 1.3e0 ELSE chord END AS drawn FROM pr)"""


def spans_drawn(v):
    rows = sq.span_rows(v.tracks, v.spans).join(v.tracks.selectExpr("route_id", "number AS lo", "source AS psrc"), ["route_id", "lo"])
    return rows.withColumn("drawn", F.when(F.col("psrc") == "purchase", F.col("chord") * 1.3).otherwise(F.col("chord")))


IMP = f"""{SPR}, nx AS (SELECT a.*, lead(meters) OVER w AS nm, lead(drawn) OVER w AS nd, lead(pl) OVER w = lead(ph) OVER w AS nsame, lag(drawn) OVER w AS pd, lag(pl) OVER w = lag(ph) OVER w AS psame FROM ar a WINDOW w AS (PARTITION BY route_id ORDER BY lo)),
 ee AS (SELECT *, CASE WHEN nsame AND nd > 1e-6 AND nm > 0 THEN nm * drawn / nd WHEN NOT nsame AND nm > 0 AND chord > 1e-6 AND drawn / chord > 1.15e0 THEN nm END AS eo,
   CASE WHEN psame AND pd > 1e-6 THEN drawn / pd END AS ir, chord > 1e-6 AND drawn / chord > 1.25e0 AS heavy, psrc = 'error' AS tap, pl = ph AS fillable,
   CASE WHEN nsame AND nd > 1e-6 AND nm > 0 THEN nd END AS opt FROM nx)"""


@query("w9_impute_spans", f"""WITH RECURSIVE {IMP}, rc AS (SELECT route_id, lo, CASE WHEN meters > 0 THEN meters WHEN fillable THEN coalesce(eo, NULL) END AS m, NOT coalesce(meters > 0, false) AND fillable AND eo IS NOT NULL AS filled FROM ee WHERE lo = 1
  UNION ALL SELECT route_id, lo, CASE WHEN meters > 0 THEN meters WHEN fillable AND g > 0 THEN g ELSE meters END, NOT coalesce(meters > 0, false) AND fillable AND coalesce(g > 0, false) FROM
   (SELECT e.*, CASE WHEN ei IS NOT NULL AND eo IS NOT NULL AND (heavy OR coalesce(chord / least(CASE WHEN im > 0 THEN pdx END, opt) < 0.55e0, false)) THEN greatest(ei, eo, (im + nm) / 2, CASE WHEN tap THEN ei + eo END) ELSE coalesce(eo, ei) END AS g FROM
    (SELECT e.*, CASE WHEN r.m > 0 THEN r.m END AS im, CASE WHEN r.m > 0 THEN r.m END * ir AS ei, CASE WHEN psame AND pd > 1e-6 THEN pd END AS pdx FROM ee e JOIN rc r ON e.route_id = r.route_id AND e.lo = r.lo + 1) e) e)
 SELECT route_id, lo, round(m, 6) AS meters, filled FROM rc""")
def _(v):
    rows = spans_drawn(v).withColumn("tap", F.col("psrc") == "error")
    return rounded(sq.impute_spans(rows), "meters")


@query("w10_impute_cross_page", f"""WITH RECURSIVE {SPR}, b AS (SELECT *, CASE WHEN pl <> ph THEN NULL ELSE meters END AS m0 FROM ar), c AS (SELECT *, lead(m0) OVER (PARTITION BY route_id ORDER BY lo) AS nm FROM b),
 rc AS (SELECT route_id, lo, m0 AS m, false AS filled FROM c WHERE lo = 1 UNION ALL
  SELECT c.route_id, c.lo, CASE WHEN c.m0 > 0 THEN c.m0 WHEN pl <> ph THEN coalesce((r.m + nm) / 2, r.m, nm) ELSE m0 END, NOT coalesce(c.m0 > 0, false) AND pl <> ph AND coalesce(r.m, nm) IS NOT NULL FROM c JOIN rc r ON c.route_id = r.route_id AND c.lo = r.lo + 1)
 SELECT route_id, lo, round(m, 9) AS meters, filled FROM rc""")
def _(v):
    rows = spans_drawn(v).withColumn("meters", F.when(F.col("page_lo") == F.col("page_hi"), F.col("meters")))
    return rounded(sq.impute_cross_page(rows), "meters", places=9)


@query("w23_prefill_gaps")
def _(v):
    taps = lw.tap_poles(hits(v, tapped(v))).where("is_tap").select("route_id", "number")
    return rounded(sq.prefill_gaps(spans_drawn(v), taps), "meters")


PAIRS = "SELECT a.route_id, a.number AS src, b.number AS dst FROM v_tracks a JOIN v_tracks b ON b.route_id = a.route_id AND b.number = a.number + 1 + CAST(a.row_id % 7 AS INT)"


def far_pairs(v):
    ahead = v.tracks.selectExpr("route_id", "number AS src", "number + 1 + CAST(row_id % 7 AS INT) AS dst")
    return ahead.join(v.tracks.selectExpr("route_id", "number AS dst"), ["route_id", "dst"]).select("route_id", "src", "dst")


@query("w11_chain_sum", f"""WITH p AS ({PAIRS}) SELECT route_id, src, dst, round(CASE WHEN k = dst - src THEN t END, 6) AS chain_m FROM (SELECT p.route_id, src, dst, count(s.meters) AS k, sum(s.meters) AS t FROM p LEFT JOIN v_spans s ON s.route_id = p.route_id AND s.lo >= src AND s.lo < dst GROUP BY p.route_id, src, dst)""")
def _(v):
    return rounded(sq.chain_sum(v.spans, far_pairs(v)).drop("partial_m"), "chain_m")


@query("w11_hop_metres", f"""WITH p AS ({PAIRS}), c AS (SELECT p.route_id, src, dst, sum(s.meters) AS t FROM p LEFT JOIN v_spans s ON s.route_id = p.route_id AND s.lo >= src AND s.lo < dst GROUP BY p.route_id, src, dst)
 SELECT c.route_id, src, dst, round(coalesce(d.meters, t), 6) AS hop_m FROM c LEFT JOIN v_all_spans d ON d.route_id = c.route_id AND d.lo = src AND d.hi = dst AND d.meters > 0""")
def _(v):
    return rounded(sq.hop_metres(v.all_spans, far_pairs(v)), "hop_m")


TAPS = "SELECT route_id, lo, hi, meters, CASE WHEN hi = lo + 1 AND lo % 3 = 0 THEN 'bifurcation-tap' ELSE source END AS source FROM v_all_spans"


@query("w26_next_hop_label", f"""WITH s AS ({TAPS}) SELECT n.route_id, n.lo AS number, round(CASE WHEN n.source = 'bifurcation-tap' THEN coalesce(a.meters, CASE WHEN m.meters > n.meters THEN greatest(m.meters - n.meters, 2 * least(10, greatest(2, 0.15e0 * m.meters))) END, n.meters) ELSE n.meters END, 6) AS label
 FROM s n LEFT JOIN s a ON a.route_id = n.route_id AND a.lo = n.hi AND a.hi = n.hi + 1 AND a.meters > 0 LEFT JOIN s m ON m.route_id = n.route_id AND m.lo = n.lo AND m.hi = n.lo + 2 AND m.meters > 0 WHERE n.hi = n.lo + 1 AND n.meters > 0""")
def _(v):
    spans = v.all_spans.withColumn("source", F.when((F.col("hi") == F.col("lo") + 1) & (F.col("lo") % 3 == 0), "bifurcation-tap").otherwise(F.col("source")))
    return rounded(sq.next_hop_label(spans, v.tracks), "label")


@query("w12_interpolate_uncalibrated", """WITH RECURSIVE p AS (SELECT route_id, number, CASE WHEN source = 'error' THEN 9 ELSE page END AS page, x, y, source <> 'error' AS ok FROM v_tracks),
 q AS (SELECT *, lead(page) OVER w AS np, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(ok) OVER w AS nok FROM p WINDOW w AS (PARTITION BY route_id ORDER BY number)),
 rc AS (SELECT route_id, number, CASE WHEN ok THEN page WHEN nok THEN np ELSE page END AS page, x, y, ok OR coalesce(nok, false) AS ok, CASE WHEN ok THEN 'no' WHEN nok THEN 'reassigned' ELSE 'stuck' END AS moved FROM q WHERE number = 1
  UNION ALL SELECT q.route_id, q.number, CASE WHEN q.ok THEN q.page WHEN r.ok THEN r.page WHEN nok THEN np ELSE q.page END, CASE WHEN NOT q.ok AND r.ok AND coalesce(nok, false) AND r.page = np THEN (r.x + nx) / 2 ELSE q.x END,
   CASE WHEN NOT q.ok AND r.ok AND coalesce(nok, false) AND r.page = np THEN (r.y + ny) / 2 ELSE q.y END, q.ok OR r.ok OR coalesce(nok, false),
   CASE WHEN q.ok THEN 'no' WHEN r.ok AND coalesce(nok, false) AND r.page = np THEN 'interpolated' WHEN r.ok OR coalesce(nok, false) THEN 'reassigned' ELSE 'stuck' END FROM q JOIN rc r ON q.route_id = r.route_id AND q.number = r.number + 1)
 SELECT route_id, number, page, round(x, 6) AS x, round(y, 6) AS y, moved FROM rc""")
def _(v):
    poles = v.tracks.select("route_id", "number", F.when(F.col("source") == "error", 9).otherwise(F.col("page")).alias("page"), "x", "y")
    return rounded(sq.interpolate_uncalibrated(poles, poles.where("page < 9")), "x", "y")


MOVED = "SELECT route_id, number, page, (CASE WHEN source = 'view' THEN x + 50 ELSE x END) / 2 AS x, y FROM v_tracks"
NEIGH = """LEFT JOIN v_spans i ON i.route_id = p.route_id AND i.hi = p.number AND i.meters > 0 LEFT JOIN v_spans o ON o.route_id = p.route_id AND o.lo = p.number AND o.meters > 0"""


@query("w13_bracket_snap", f"""WITH t AS ({MOVED}), q AS (SELECT p.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, i.meters AS mi, o.meters AS mo FROM t p LEFT JOIN t a ON a.route_id = p.route_id AND a.number = p.number - 1 LEFT JOIN t b ON b.route_id = p.route_id AND b.number = p.number + 1 {NEIGH}),
 w AS (SELECT *, sqrt(pow(x - ax, 2) + pow(y - ay, 2)) AS ci, sqrt(pow(bx - x, 2) + pow(by_ - y, 2)) AS co, mi / (mi + mo) AS f, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS wl FROM q),
 z AS (SELECT *, ax + f * (bx - ax) AS sx, ay + f * (by_ - ay) AS sy FROM w),
 k AS (SELECT *, coalesce((abs(ci - mi) >= 12 OR CASE WHEN ci > 0.5e0 THEN ci / mi ELSE 0 END NOT BETWEEN 1 / 1.55e0 AND 1.55e0 OR abs(co - mo) >= 12 OR CASE WHEN co > 0.5e0 THEN co / mo ELSE 0 END NOT BETWEEN 1 / 1.55e0 AND 1.55e0)
   AND sqrt(pow(x - sx, 2) + pow(y - sy, 2)) >= 8 AND abs(f * wl - mi) + abs((1 - f) * wl - mo) < abs(ci - mi) + abs(co - mo), false) AS snapped FROM z)
 SELECT route_id, number, round(CASE WHEN snapped THEN sx ELSE x END, 6) AS x, round(CASE WHEN snapped THEN sy ELSE y END, 6) AS y, snapped FROM k""")
def _(v):
    poles = v.tracks.select("route_id", "number", "page", (F.when(F.col("source") == "view", F.col("x") + 50).otherwise(F.col("x")) / 2).alias("x"), "y")
    return rounded(sq.bracket_snap(poles, v.spans), "x", "y")


WADJ = f"""SELECT p.route_id, p.number, greatest(abs({hav_sql('a.lat', 'a.lon', 'p.lat', 'p.lon')} - i.meters), abs({hav_sql('p.lat', 'p.lon', 'b.lat', 'b.lon')} - o.meters)) AS worst_m FROM v_tracks p LEFT JOIN v_tracks a ON a.route_id = p.route_id AND a.number = p.number - 1
 LEFT JOIN v_tracks b ON b.route_id = p.route_id AND b.number = p.number + 1 {NEIGH}"""


@query("w14_worst_adjacent_error", f"SELECT route_id, number, round(worst_m, 6) AS worst_m FROM ({WADJ})")
def _(v):
    return rounded(sq.worst_adjacent_error(v.tracks, v.spans), "worst_m")


@query("w19_expected_arc", f"""WITH {HITS}, {DRAWN}, dr2 AS (SELECT route_id, page, CASE WHEN regr_slope(t, point_id) < 0 THEN -1 ELSE 1 END AS dir, arg_min(t, point_id) AS t0 FROM hit GROUP BY ALL),
 c AS (SELECT p.route_id, p.page, p.number, sum(CASE WHEN lag_n IS NULL THEN 0 ELSE coalesce(s.meters, 0) END) OVER (PARTITION BY p.route_id, p.page ORDER BY p.number) AS cum FROM (SELECT *, lag(number) OVER (PARTITION BY route_id, page ORDER BY number) AS lag_n FROM v_tracks) p LEFT JOIN v_spans s ON s.route_id = p.route_id AND s.hi = p.number)
 SELECT route_id, page, number, round(t0 + dir * cum / scale, 5) AS expected_t FROM c JOIN ds USING (route_id, page) JOIN dr2 USING (route_id, page)""")
def _(v):
    found = hits(v)
    out = sq.expected_arc(v.tracks, v.spans, found, ft.drawn_scale(v.tracks, v.spans), lw.arc_direction(found))
    return rounded(out, "expected_t", places=5)


MIR = f"""{ARC}, {hits_sql("SELECT route_id, page, CASE WHEN route_id % 3 = 0 THEN page * 32 - 15 - number ELSE number END AS point_id, x, y FROM v_tracks")}, {DRAWN},
 mm AS (SELECT route_id, page, min(point_id) AS lo, max(point_id) AS hi FROM hit GROUP BY ALL),
 st AS (SELECT a.route_id, a.page, a.point_id AS number, abs(b.t - a.t) * scale AS arc, mm.lo, mm.hi FROM mm JOIN hit a ON a.route_id = mm.route_id AND a.page = mm.page JOIN hit b ON b.route_id = a.route_id AND b.page = a.page AND b.point_id = a.point_id + 1 JOIN ds ON ds.route_id = a.route_id AND ds.page = a.page),
 fr AS (SELECT st.route_id, st.page, st.lo, st.hi, avg(abs(arc - f.meters)) AS forward, avg(abs(arc - m.meters)) AS mirrored FROM st LEFT JOIN v_spans f ON f.route_id = st.route_id AND f.lo = st.number LEFT JOIN v_spans m ON m.route_id = st.route_id AND m.lo = st.lo + st.hi - st.number - 1 GROUP BY st.route_id, st.page, st.lo, st.hi)"""


def flipped_hits(v):
    turned = v.tracks.withColumn("number", F.when(F.col("route_id") % 3 == 0, F.col("page") * 32 - 15 - F.col("number")).otherwise(F.col("number")))
    return hits(v, turned).select("route_id", "page", "number", "t")


@query("a13_arc_residual", f"""WITH {MIR}, n AS (SELECT route_id, page, min(point_id) AS lo, max(point_id) AS hi, count(*) AS n FROM hit GROUP BY ALL) SELECT n.route_id, n.page, n.lo, n.hi, n, round(forward, 6) AS forward, round(mirrored, 6) AS mirrored FROM n LEFT JOIN fr USING (route_id, page)""")
def _(v):
    out = sq.arc_residual(flipped_hits(v), v.spans, ft.drawn_scale(v.tracks, v.spans))
    return rounded(out.drop("run"), "forward", "mirrored")


@query("q11_mirror_numbers", f"""WITH {MIR} SELECT h.route_id, h.page, h.point_id AS number, CASE WHEN coalesce(mirrored + 0.5e0 < forward AND mirrored <= 20, false) THEN n.lo + n.hi - h.point_id ELSE h.point_id END AS new_number FROM hit h
 JOIN (SELECT route_id, page, min(point_id) AS lo, max(point_id) AS hi, count(*) AS n FROM hit GROUP BY ALL HAVING count(*) >= 3) n USING (route_id, page) LEFT JOIN fr ON fr.route_id = h.route_id AND fr.page = h.page
 UNION ALL SELECT h.route_id, h.page, h.point_id, h.point_id FROM hit h JOIN (SELECT route_id, page FROM hit GROUP BY ALL HAVING count(*) < 3) n USING (route_id, page)""")
def _(v):
    out = sq.mirror_numbers(flipped_hits(v), v.spans, ft.drawn_scale(v.tracks, v.spans), gain=0.5)
    return out.select("route_id", "page", "number", "new_number")


MARK = "mk AS (SELECT route_id, mark_id, page, min(x) AS x, min(y) AS y FROM v_markers GROUP BY ALL)"


def markers(v):
    return v.markers.groupBy("route_id", "mark_id", "page").agg(F.min("x").alias("x"), F.min("y").alias("y"))


@query("o1_reading_order", f"""WITH {MARK}, b AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL OR x - lag(x) OVER w > 10 THEN x END AS o FROM mk WINDOW w AS (PARTITION BY route_id, page ORDER BY x, mark_id)),
 c AS (SELECT *, max(o) OVER (PARTITION BY route_id, page ORDER BY x, mark_id ROWS UNBOUNDED PRECEDING) AS col FROM b) SELECT route_id, mark_id, page, row_number() OVER (PARTITION BY route_id ORDER BY page, col, y, mark_id) AS pos FROM c""")
def _(v):
    return sq.reading_order(markers(v)).select("route_id", "mark_id", "page", "pos")


@query("o2_route_order", f"""WITH {MARK}, ax AS (SELECT route_id, page, 0.5e0 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS th FROM mk GROUP BY ALL),
 b AS (SELECT mk.*, CAST(floor((x * cos(th) + y * sin(th)) / 10) AS BIGINT) AS bin FROM mk JOIN ax USING (route_id, page)),
 f AS (SELECT *, first_value(x) OVER w AS fx, last_value(x) OVER w AS lx, first_value(y) OVER w AS fy, last_value(y) OVER w AS ly FROM b WINDOW w AS (PARTITION BY route_id, page ORDER BY bin, y, mark_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 t AS (SELECT *, CASE WHEN CASE WHEN page = 1 THEN sqrt(pow(lx - 600, 2) + ly * ly) < sqrt(pow(fx - 600, 2) + fy * fy) ELSE lx - fx > 10 END THEN -1 ELSE 1 END AS sg FROM f)
 SELECT route_id, mark_id, row_number() OVER (PARTITION BY route_id ORDER BY page, bin * sg, y * sg, mark_id * sg) AS number FROM t""")
def _(v):
    rows = markers(v)
    entries = rows.where("page = 1").select("route_id", "page").distinct().selectExpr("*", "600e0 AS entry_x", "0e0 AS entry_y")
    return sq.route_order(rows, entries).select("route_id", "mark_id", "number")


KEY = """en AS (SELECT route_id, page, arg_min(x, number) AS fx, arg_min(y, number) AS fy, arg_max(x, number) AS lx, arg_max(y, number) AS ly FROM v_tracks GROUP BY ALL),
 kq AS (SELECT t.route_id, t.page, t.number, t.x, t.y, t.v, CASE WHEN l < 1e-6 THEN x ELSE x * (lx - fx) / l + y * (ly - fy) / l END AS key FROM v_tracks t JOIN (SELECT *, sqrt(pow(lx - fx, 2) + pow(ly - fy, 2)) AS l FROM en) USING (route_id, page))"""


@query("o3_route_key", f"WITH {KEY} SELECT route_id, page, number, round(key, 6) AS key FROM kq")
def _(v):
    return rounded(sq.route_key(v.tracks).select("route_id", "page", "number", "key"), "key")


@query("o3_order_violations", f"""WITH {KEY} SELECT k.route_id, k.number, CASE WHEN p.key IS NOT NULL THEN k.key + k.v < least(p.key, coalesce(n.key, p.key)) - 12 OR k.key + k.v > greatest(p.key, coalesce(n.key, p.key)) + 12
  WHEN n.key IS NOT NULL THEN CASE WHEN k.key <= n.key THEN k.key + k.v > n.key + 12 ELSE k.key + k.v < n.key - 12 END ELSE false END AS violates
 FROM kq k LEFT JOIN kq p ON p.route_id = k.route_id AND p.page = k.page AND p.number = k.number - 1 LEFT JOIN kq n ON n.route_id = k.route_id AND n.page = k.page AND n.number = k.number + 1""")
def _(v):
    keyed = sq.route_key(v.tracks)
    cand = keyed.select("route_id", "page", "number", (F.col("key") + F.col("v")).alias("cand_key"))
    return sq.order_violations(keyed.select("route_id", "page", "number", "key"), cand).select("route_id", "number", "violates")


@query("j20_chord_neighbours", """SELECT route_id, page, number, max(CASE WHEN source <> 'error' THEN number END) OVER (PARTITION BY route_id, page ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_number,
 min(CASE WHEN source <> 'error' THEN number END) OVER (PARTITION BY route_id, page ORDER BY number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS right_number FROM v_tracks""")
def _(v):
    poles = v.tracks.selectExpr("route_id", "page", "number", "source = 'error' AS is_tap")
    return sq.chord_neighbours(poles).select("route_id", "page", "number", "left_number", "right_number")
