"""Graph operators over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from routekit.operators import graph as gr
from routekit.operators import quality as ql
from routekit.operators import regions as rg
from routekit.plans.matching import ADJ, base_adj, inferred_jumps
from routekit.plans.quality import residual_rows
from routekit.plans.registry import query, r6, rounded

# labelled spans plus long main jumps: routes fall apart at the tombstones, jumps tie some parts together
LINK = """lk AS (SELECT route_id, lo AS u, hi AS v, meters AS w FROM v_spans WHERE meters > 0 UNION ALL SELECT route_id, lo, hi, meters FROM v_jumps WHERE source = 'bifurcation-main'),
 bw AS (SELECT DISTINCT route_id, u, v, w FROM (SELECT * FROM lk UNION ALL SELECT route_id, v, u, w FROM lk))"""
REACH = f"""{LINK}, nd AS (SELECT DISTINCT route_id, u AS node FROM bw), cl AS (SELECT route_id, node, node AS seen FROM nd UNION SELECT c.route_id, c.node, b.v FROM cl c JOIN bw b ON b.route_id = c.route_id AND b.u = c.seen),
 cm AS (SELECT route_id, node, min(seen) AS component FROM cl GROUP BY ALL)"""


def links(v):
    jumps = v.jumps.where("source = 'bifurcation-main'")
    return v.spans.where("meters > 0").unionByName(jumps).selectExpr("route_id", "lo AS u", "hi AS v", "meters AS w")


@query("g3_components", f"WITH RECURSIVE {REACH} SELECT * FROM cm")
def _(v):
    return gr.components(links(v))


@query("a16_cable_degree", f"WITH {LINK} SELECT route_id, u AS node, count(DISTINCT v) AS degree, array_to_string(list_sort(list(DISTINCT v)), ',') AS neighbours FROM bw GROUP BY 1, 2")
def _(v):
    out = gr.degree(links(v))
    return out.select("route_id", "node", "degree", F.array_join(F.transform("neighbours", lambda n: n.cast("string")), ",").alias("neighbours"))


@query("g11_junctions", f"WITH {LINK} SELECT route_id, u AS node, count(DISTINCT v) AS degree FROM bw GROUP BY 1, 2 HAVING count(DISTINCT v) >= 3 AND bool_or(abs(v - u) > 1)")
def _(v):
    return gr.junctions(links(v))


@query("g16_union_adjacency", "WITH a AS (SELECT route_id, lo AS u, hi AS v FROM v_spans WHERE meters > 0 UNION ALL SELECT route_id, lo, hi FROM v_jumps) SELECT route_id, u, v FROM a UNION SELECT route_id, v, u FROM a")
def _(v):
    return gr.union_adjacency(v.spans.where("meters > 0").selectExpr("route_id", "lo AS u", "hi AS v"), v.jumps.selectExpr("route_id", "lo AS u", "hi AS v"))


@query("g6_bfs_tree", f"""WITH RECURSIVE {LINK}, rt AS (SELECT route_id, min(u) AS node FROM bw GROUP BY 1), ds AS (SELECT route_id, node, 0 AS level FROM rt UNION SELECT d.route_id, b.v, d.level + 1 FROM ds d JOIN bw b ON b.route_id = d.route_id AND b.u = d.node WHERE d.level < 64),
 lv AS (SELECT route_id, node, min(level) AS level FROM ds GROUP BY ALL) SELECT route_id, node, level FROM lv""")
def _(v):
    return gr.bfs_tree(links(v)).select("route_id", "node", "level")


# no shortest way has more hops than its route has nodes
HOPS = "(SELECT max(k) FROM (SELECT count(DISTINCT u) AS k FROM bw GROUP BY route_id))"


@query("g8_shortest_lengths", f"""WITH RECURSIVE {LINK}, sr AS (SELECT route_id, min(u) AS source FROM bw GROUP BY 1), ds AS (SELECT route_id, source, source AS node, 0e0 AS length, 0 AS hop FROM sr
  UNION ALL SELECT d.route_id, d.source, b.v, min(d.length + b.w), d.hop + 1 FROM ds d JOIN bw b ON b.route_id = d.route_id AND b.u = d.node WHERE d.hop < {HOPS} GROUP BY d.route_id, d.source, b.v, d.hop)
 SELECT route_id, source, node, round(min(length), 6) AS length FROM ds GROUP BY 1, 2, 3""")
def _(v):
    adj = links(v)
    sources = adj.groupBy("route_id").agg(F.min(F.least("u", "v")).alias("node"))
    return rounded(gr.shortest_lengths(adj, sources), "length")


@query("g7_cluster_points", """WITH RECURSIVE p AS (SELECT route_id, page, sym_id, x, y FROM v_symbols), c AS (SELECT route_id, page, sym_id, sym_id AS seen FROM p UNION SELECT c.route_id, c.page, c.sym_id, q.sym_id FROM c JOIN p s ON s.sym_id = c.seen JOIN p q ON q.route_id = s.route_id AND q.page = s.page AND sqrt(pow(q.x - s.x, 2) + pow(q.y - s.y, 2)) <= 52),
 m AS (SELECT sym_id, min(seen) AS cluster FROM c GROUP BY 1) SELECT p.route_id, p.page, cluster, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM p JOIN m USING (sym_id) GROUP BY ALL""")
def _(v):
    points = v.symbols.select("route_id", "page", F.col("sym_id").alias("point_id"), "x", "y")
    return rounded(gr.cluster_points(points, 52.0), "x", "y")


GLUED = """en AS (SELECT region_id, poly, edge_id, 0 AS side, ax AS x, ay AS y FROM v_base_edges UNION ALL SELECT region_id, poly, edge_id, 1, bx, "by" FROM v_base_edges),
 sp AS (SELECT region_id, x, y, min(edge_id * 2 + side) AS pid FROM en GROUP BY ALL), gl AS (SELECT region_id, list_reduce(list([{'i': pid, 'x': x, 'y': y}] ORDER BY pid), lambda acc, q: CASE WHEN len(list_filter(acc, lambda p: sqrt(pow(p.x - q[1].x, 2) + pow(p.y - q[1].y, 2)) < 0.05e0)) > 0 THEN acc ELSE list_concat(acc, q) END) AS ps FROM sp GROUP BY 1),
 kp AS (SELECT region_id, u.i AS node, u.x AS x, u.y AS y FROM (SELECT region_id, unnest(ps) AS u FROM gl))"""


@query("g1_cable_graph", f"""WITH {GLUED},
 hm AS (SELECT sp.region_id, sp.x, sp.y, arg_min(kp.node, [sqrt(pow(kp.x - sp.x, 2) + pow(kp.y - sp.y, 2)), kp.node]) AS node FROM sp JOIN kp ON kp.region_id = sp.region_id AND sqrt(pow(kp.x - sp.x, 2) + pow(kp.y - sp.y, 2)) <= 0.05e0 GROUP BY ALL),
 pl AS (SELECT en.region_id, poly, edge_id, side, node FROM en JOIN hm USING (region_id, x, y)), ss AS (SELECT a.region_id, a.node AS u, b.node AS v FROM pl a JOIN pl b ON b.region_id = a.region_id AND b.edge_id = a.edge_id AND a.side = 0 AND b.side = 1),
 tp AS (SELECT DISTINCT region_id, node FROM (SELECT region_id, poly, node FROM pl GROUP BY ALL HAVING count(*) = 1)), fu AS (SELECT a.region_id, a.node AS u, b.node AS v FROM tp x JOIN kp a ON a.region_id = x.region_id AND a.node = x.node JOIN tp y ON y.region_id = x.region_id JOIN kp b ON b.region_id = y.region_id AND b.node = y.node WHERE a.node < b.node AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.3e0),
 al AS (SELECT * FROM ss UNION ALL SELECT * FROM fu) SELECT DISTINCT region_id, u, v FROM (SELECT * FROM al UNION ALL SELECT region_id, v, u FROM al) WHERE u <> v""")
def _(v):
    _, edges = gr.cable_graph(v.base_edges)
    return edges


def owned(v):
    nodes, edges = gr.cable_graph(v.base_edges)
    poles = v.base.select("region_id", F.col("idx").alias("number"), "x", "y")
    return nodes, edges, gr.own_vertices(nodes, poles)


@query("g2_own_vertices", f"""WITH {GLUED} SELECT kp.region_id, kp.node, arg_min(b.idx, [sqrt(pow(b.x - kp.x, 2) + pow(b.y - kp.y, 2)), b.idx]) AS owner FROM kp JOIN v_base b ON b.region_id = kp.region_id AND sqrt(pow(b.x - kp.x, 2) + pow(b.y - kp.y, 2)) <= 7e0 GROUP BY ALL""")
def _(v):
    return owned(v)[2]


@query("g4_contract")
def _(v):
    _, edges, owner = owned(v)
    return gr.contract(edges, owner)


@query("g5_bridge_components")
def _(v):
    poles = v.tracks.select("route_id", "number", F.col("e").alias("x"), F.col("n").alias("y"))
    return rounded(gr.bridge_components(links(v), poles), "d")


@query("g9_multi_hop_match", f"""WITH RECURSIVE {ADJ}, bb AS (SELECT DISTINCT region_id, u, v, w FROM (SELECT * FROM ad UNION ALL SELECT region_id, v, u, w FROM ad)), tk AS (SELECT idx AS node FROM v_base WHERE block = 'click'),
 sr AS (SELECT b.region_id, b.idx AS node, s.meters + CASE WHEN s.lo % 2 = 0 THEN 28 ELSE 0 END AS label FROM v_spans s JOIN v_base b ON b.route_id = s.route_id AND b.idx = s.route_id * 64 + s.lo - 1 WHERE s.meters > 0),
 wk AS (SELECT region_id, node AS sid, node AS u, label, 0e0 AS total, [node] AS path, -1 AS hops FROM sr UNION ALL SELECT w.region_id, sid, bb.v, label, total + bb.w, list_append(path, bb.v), hops + 1 FROM wk w JOIN bb ON bb.region_id = w.region_id AND bb.u = w.u
   WHERE hops < 2 AND NOT list_contains(path, bb.v) AND bb.v NOT IN (SELECT node FROM tk) AND total + bb.w <= label + 6),
 fo AS (SELECT sid, u AS endpoint, hops, abs(total - label) AS delta FROM wk WHERE hops >= 0 AND abs(total - label) <= 6), dg AS (SELECT u AS endpoint, count(DISTINCT v) >= 2 AS onward FROM bb GROUP BY 1),
 rk AS (SELECT fo.*, coalesce(onward, false) AS onward, row_number() OVER (PARTITION BY sid, coalesce(onward, false) ORDER BY hops, delta, endpoint) AS k FROM fo LEFT JOIN dg USING (endpoint)),
 pa AS (SELECT coalesce(a.sid, b.sid) AS sid, a.endpoint AS ae, a.hops AS ah, a.delta AS ad, b.endpoint AS be, b.hops AS bh, b.delta AS bd FROM (SELECT * FROM rk WHERE onward AND k = 1) a FULL JOIN (SELECT * FROM rk WHERE NOT onward AND k = 1) b ON a.sid = b.sid)
 SELECT sid AS source_id, CASE WHEN usea THEN ae ELSE be END AS endpoint, CASE WHEN usea THEN ah ELSE bh END AS hops, round(CASE WHEN usea THEN ad ELSE bd END, 6) AS delta FROM (SELECT *, be IS NULL OR (ae IS NOT NULL AND NOT (bd < 0.5e0 AND ad > 2)) AS usea FROM pa)""")
def _(v):
    spans = v.spans.where("meters > 0").selectExpr("route_id * 64 + lo - 1 AS node", "meters + CASE WHEN lo % 2 = 0 THEN 28 ELSE 0 END AS label")
    sources = v.base.selectExpr("region_id", "idx AS node").join(spans, "node").select("region_id", F.col("node").alias("source_id"), "node", "label")
    claimed = v.base.where("block = 'click'").selectExpr("region_id", "idx AS node")
    return rounded(gr.multi_hop_match(base_adj(v), sources, claimed, 6.0, 2).drop("region_id"), "delta")


@query("g19_open_arms", f"""WITH {LINK}, dg AS (SELECT route_id, u, count(DISTINCT v) AS d FROM bw GROUP BY 1, 2), vs AS (SELECT route_id, number FROM v_tracks WHERE source <> 'error'), hb AS (SELECT vs.* FROM vs JOIN dg ON dg.route_id = vs.route_id AND dg.u = vs.number WHERE d >= 3)
 SELECT DISTINCT bw.route_id, bw.v AS node FROM bw JOIN hb ON hb.route_id = bw.route_id AND hb.number = bw.u WHERE (bw.route_id, bw.v) NOT IN (SELECT (route_id, number) FROM vs)""")
def _(v):
    visited = v.tracks.where("source <> 'error'").selectExpr("route_id", "number AS node", "number AS visit_order")
    return gr.open_arms(visited, links(v))[0]


@query("g19_last_junction", f"""WITH {LINK}, dg AS (SELECT route_id, u, count(DISTINCT v) AS d FROM bw GROUP BY 1, 2) SELECT t.route_id, max(number) AS junction FROM v_tracks t JOIN dg ON dg.route_id = t.route_id AND dg.u = t.number WHERE source <> 'error' AND d >= 3 GROUP BY 1""")
def _(v):
    visited = v.tracks.where("source <> 'error'").selectExpr("route_id", "number AS node", "number AS visit_order")
    return gr.open_arms(visited, links(v))[1]


def tree_links(v):
    """Each pole hangs on an earlier pole of its route: a forest by construction."""
    return v.tracks.where("number > 1").selectExpr("route_id", "number AS v", "CASE WHEN source = 'error' THEN 1 ELSE CAST(floor(number / 2e0) AS INT) END AS u", "v AS meters")


TREE = "tl AS (SELECT route_id, number AS v, CASE WHEN source = 'error' THEN 1 ELSE CAST(floor(number / 2e0) AS INT) END AS u, v AS meters FROM v_tracks WHERE number > 1)"


def walk(v):
    slots = v.tracks.selectExpr("route_id", "number AS node", "1 + number % 2 AS slots")
    inbound = tree_links(v).selectExpr("route_id", "v AS node", "u AS from_node")
    return gr.branch_walk(tree_links(v), slots, inbound)


@query("g10_branch_order", f"""WITH RECURSIVE {TREE}, pt AS (SELECT route_id, 1 AS node, ['00001'] AS path FROM tl GROUP BY 1 UNION ALL SELECT p.route_id, t.v, list_append(p.path, lpad(CAST(t.v AS VARCHAR), 5, '0')) FROM pt p JOIN tl t ON t.route_id = p.route_id AND t.u = p.node)
 SELECT route_id, node, row_number() OVER (PARTITION BY route_id ORDER BY array_to_string(path, '/')) AS visit FROM pt""")
def _(v):
    return walk(v)[0]


@query("g10_branch_arms", f"""WITH {TREE}, bw AS (SELECT route_id, u, v, meters FROM tl UNION ALL SELECT route_id, v, u, meters FROM tl), dg AS (SELECT route_id, u FROM bw GROUP BY ALL HAVING count(DISTINCT v) >= 3)
 SELECT bw.route_id, bw.u AS junction, bw.v AS arm, meters FROM bw JOIN dg USING (route_id, u) WHERE (bw.route_id, bw.u, bw.v) NOT IN (SELECT (route_id, v, u) FROM tl)""")
def _(v):
    return walk(v)[1]


@query("g10_branch_slots")
def _(v):
    return walk(v)[2]


@query("g12_linear_runs", f"""WITH RECURSIVE {LINK}, jn AS (SELECT route_id, u AS node FROM bw GROUP BY ALL HAVING count(DISTINCT v) >= 3 AND bool_or(abs(v - u) > 1)), inn AS (SELECT DISTINCT route_id, u, v FROM bw WHERE (route_id, u) NOT IN (SELECT (route_id, node) FROM jn) AND (route_id, v) NOT IN (SELECT (route_id, node) FROM jn)),
 nd AS (SELECT DISTINCT route_id, u AS node FROM bw WHERE (route_id, u) NOT IN (SELECT (route_id, node) FROM jn)), cl AS (SELECT route_id, node, node AS seen FROM nd UNION SELECT c.route_id, c.node, i.v FROM cl c JOIN inn i ON i.route_id = c.route_id AND i.u = c.seen), cm AS (SELECT route_id, node, min(seen) AS run FROM cl GROUP BY ALL),
 bs AS (SELECT bw.route_id, bw.u AS node, min(bw.v) AS hub FROM bw JOIN jn ON jn.route_id = bw.route_id AND jn.node = bw.v GROUP BY ALL), st AS (SELECT cm.route_id, run, coalesce(arg_min(cm.node, [hub, cm.node]) FILTER (hub IS NOT NULL), min(cm.node)) AS node FROM cm LEFT JOIN bs USING (route_id, node) GROUP BY ALL),
 hp AS (SELECT route_id, run, node, 0 AS pos FROM st UNION SELECT h.route_id, h.run, i.v, h.pos + 1 FROM hp h JOIN inn i ON i.route_id = h.route_id AND i.u = h.node WHERE h.pos < {HOPS}) SELECT route_id, run, node, min(pos) AS pos FROM hp GROUP BY 1, 2, 3""")
def _(v):
    adj = links(v)
    return gr.linear_runs(adj, gr.junctions(adj))


def topology_inputs(v):
    assign = v.tracks.selectExpr("route_id", "CAST(floor(route_id / 8) AS BIGINT) AS region_id", "number", "CASE WHEN source = 'error' AND route_id % 4 = 0 THEN row_id + 1 ELSE row_id END AS idx")
    conns = v.spans.where("meters > 0").selectExpr("route_id", "lo AS u", "hi AS v")
    steps = v.base.selectExpr("region_id", "route_id", "idx AS v", "x AS x2", "y AS y2").withColumn("u", F.col("v") - 1)
    adj = (v.base.selectExpr("region_id", "route_id", "idx AS u", "x", "y").join(steps, ["region_id", "route_id", "u"])
           .selectExpr("region_id", "u", "v", "sqrt(pow(x - x2, 2) + pow(y - y2, 2)) AS w"))
    jumps = v.jumps.where("source = 'bifurcation-main'")
    return assign, conns, adj, gr.required_degree(jumps)


@query("g17_topology_check", """WITH a AS (SELECT route_id, number, CASE WHEN source = 'error' AND route_id % 4 = 0 THEN row_id + 1 ELSE row_id END AS idx FROM v_tracks), tw AS (SELECT DISTINCT route_id FROM (SELECT route_id, idx FROM a GROUP BY ALL HAVING count(*) > 1)),
 rq AS (SELECT route_id, number, count(*) AS degree FROM (SELECT route_id, lo AS number FROM v_jumps WHERE source = 'bifurcation-main' UNION ALL SELECT route_id, hi FROM v_jumps WHERE source = 'bifurcation-main') GROUP BY ALL),
 hv AS (SELECT b.idx, (SELECT count(*) FROM v_base c WHERE c.route_id = b.route_id AND abs(c.idx - b.idx) = 1) AS have FROM v_base b), th AS (SELECT DISTINCT a.route_id FROM rq JOIN a USING (route_id, number) LEFT JOIN hv USING (idx) WHERE least(greatest(coalesce(have, 0), 1), 3) < least(greatest(degree, 1), 3)),
 st AS (SELECT route_id, idx, idx - row_number() OVER w AS part, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM v_base WINDOW w AS (PARTITION BY route_id ORDER BY idx)),
 ar AS (SELECT route_id AS base, part, idx, sum(coalesce(step, 0)) OVER (PARTITION BY route_id, part ORDER BY idx) AS c FROM st),
 ln AS (SELECT DISTINCT route_id, unnest([lo, hi]) AS number FROM v_spans WHERE meters > 0), sg AS (SELECT ln.route_id, ln.number, sum(CASE WHEN s.lo IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY ln.route_id ORDER BY ln.number) AS run FROM ln LEFT JOIN v_spans s ON s.route_id = ln.route_id AND s.hi = ln.number AND s.meters > 0),
 rn AS (SELECT sg.route_id, run, sg.number, base, part, c FROM sg JOIN a USING (route_id, number) LEFT JOIN ar USING (idx)), h0 AS (SELECT route_id, run, arg_min({'base': base, 'part': part, 'c': c}, number) AS s FROM rn GROUP BY 1, 2),
 lg AS (SELECT route_id, run, number, CASE WHEN rn.base = s.base AND rn.part = s.part THEN abs(c - s.c) END AS length FROM rn JOIN h0 USING (route_id, run)), bk AS (SELECT DISTINCT route_id FROM (SELECT *, lag(length) OVER (PARTITION BY route_id, run ORDER BY number) AS prev FROM lg) WHERE length < prev - 4)
 SELECT r.route_id, tw.route_id IS NULL AND bk.route_id IS NULL AND th.route_id IS NULL AS ok, CASE WHEN tw.route_id IS NOT NULL THEN 'collision' WHEN bk.route_id IS NOT NULL THEN 'monotonicity' WHEN th.route_id IS NOT NULL THEN 'hub-degree' END AS reason
 FROM (SELECT DISTINCT route_id FROM a) r LEFT JOIN tw USING (route_id) LEFT JOIN bk USING (route_id) LEFT JOIN th USING (route_id)""")
def _(v):
    assign, conns, adj, required = topology_inputs(v)
    return gr.topology_check(assign, conns, adj, required, gr.junctions(conns), tol=4.0)


@query("k4_accept_bar")
def _(v):
    assign, conns, adj, required = topology_inputs(v)
    topology = gr.topology_check(assign, conns, adj, required, gr.junctions(conns), tol=4.0)
    return rounded(ql.accept_bar(residual_rows(v), topology), "median_rel", places=9)


CON = """cn AS (SELECT route_id, lo AS src, hi AS dst, source, false AS gap FROM v_spans WHERE meters > 0 UNION ALL SELECT route_id, lo, hi, source, value_gap FROM (SELECT *, source = 'legacy-midpoint' AND lo % 4 = 0 AS value_gap FROM v_jumps))"""


def drawn_conns(v):
    jumps = v.jumps.selectExpr("route_id", "lo AS src", "hi AS dst", "source", "source = 'legacy-midpoint' AND lo % 4 = 0 AS gap")
    return v.spans.where("meters > 0").selectExpr("route_id", "lo AS src", "hi AS dst", "source", "false AS gap").unionByName(jumps)


@query("g13_drop_transitive", f"""WITH RECURSIVE {CON}, sd AS (SELECT route_id, src, dst FROM cn WHERE NOT gap), bw AS (SELECT route_id, src AS u, dst AS v, src AS s, dst AS d FROM sd UNION ALL SELECT route_id, dst, src, src, dst FROM sd), cd AS (SELECT route_id, src, dst FROM cn WHERE NOT gap AND source NOT IN ('bifurcation-main', 'inferred-label') AND dst > src + 1),
 re AS (SELECT route_id, src, dst, src AS here FROM cd UNION SELECT r.route_id, r.src, r.dst, b.v FROM re r JOIN bw b ON b.route_id = r.route_id AND b.u = r.here AND NOT (b.s = r.src AND b.d = r.dst) WHERE r.here <> r.dst),
 lo AS (SELECT DISTINCT route_id, src, dst FROM re WHERE here = dst), tk AS (SELECT DISTINCT route_id, src AS n FROM sd UNION SELECT route_id, dst FROM sd)
 SELECT route_id, src, dst, source, gap FROM cn WHERE (route_id, src, dst) NOT IN (SELECT (route_id, src, dst) FROM lo) AND NOT (gap AND abs(dst - src) > 1 AND (route_id, src) IN (SELECT (route_id, n) FROM tk) AND (route_id, dst) IN (SELECT (route_id, n) FROM tk))""")
def _(v):
    return gr.drop_transitive(drawn_conns(v))


STA = """so AS (SELECT route_id, src, dst, source IN ('bifurcation-main', 'inferred-label') AS tg FROM cn WHERE NOT gap), fk AS (SELECT route_id, src, list(DISTINCT dst) FILTER (tg) AS ms FROM so GROUP BY ALL HAVING count(DISTINCT dst) > 1),
 bs AS (SELECT DISTINCT so.route_id, dst AS number FROM so JOIN fk USING (route_id, src) WHERE CASE WHEN len(ms) > 0 THEN len(ms) > list_contains(ms, dst)::INT ELSE dst = src + 1 OR abs(dst - src) > 1 END)"""
MAIN = f"""{CON}, {STA}, me AS (SELECT route_id, src, dst FROM (SELECT so.*, row_number() OVER (PARTITION BY so.route_id, so.src ORDER BY CASE WHEN tg THEN 0 WHEN dst <> src + 1 AND hs AND EXISTS (SELECT 1 FROM so o WHERE o.route_id = so.route_id AND o.src = so.dst AND o.dst = so.dst + 1) THEN 1
   WHEN dst <> src + 1 AND hs AND EXISTS (SELECT 1 FROM so o WHERE o.route_id = so.route_id AND o.src = so.dst) THEN 2 WHEN dst = src + 1 THEN 3 WHEN (so.route_id, dst) NOT IN (SELECT (route_id, number) FROM bs) THEN 4 ELSE 5 END, dst) AS k
  FROM (SELECT *, bool_or(dst = src + 1) OVER (PARTITION BY route_id, src) AS hs FROM so) so) WHERE k = 1)"""


@query("g14_main_edges", f"WITH {MAIN} SELECT * FROM me")
def _(v):
    return gr.main_edges(drawn_conns(v))


@query("g14_branch_starts", f"WITH {CON}, {STA} SELECT * FROM bs")
def _(v):
    return gr.branch_starts(drawn_conns(v))


POLY = f"""{MAIN}, ie AS (SELECT route_id, dst AS node, min(src) AS f FROM so GROUP BY ALL), ed AS (SELECT so.route_id, so.src, so.dst, CASE WHEN me.dst IS NOT NULL THEN ie.f END AS pf FROM so LEFT JOIN me ON me.route_id = so.route_id AND me.src = so.src AND me.dst = so.dst LEFT JOIN ie ON ie.route_id = so.route_id AND ie.node = so.src),
 pw AS (SELECT route_id, src AS hs, dst AS hd, src, dst, 1 AS k FROM ed WHERE pf IS NULL UNION ALL SELECT p.route_id, p.hs, p.hd, e.src, e.dst, p.k + 1 FROM pw p JOIN ed e ON e.route_id = p.route_id AND e.src = p.dst AND e.pf = p.src),
 po AS (SELECT route_id, hs AS head_src, hd AS head_dst, false AS gap, k AS pos, dst AS number FROM pw UNION ALL SELECT route_id, hs, hd, false, 0, src FROM pw WHERE k = 1
   UNION ALL SELECT route_id, src, dst, true, 0, src FROM cn WHERE gap UNION ALL SELECT route_id, src, dst, true, 1, dst FROM cn WHERE gap)"""


@query("g15_route_polylines", f"WITH RECURSIVE {POLY} SELECT * FROM po")
def _(v):
    return gr.route_polylines(drawn_conns(v))
