"""Placement, sources and output over whole tables."""
from __future__ import annotations


from pyspark.sql import functions as F

from routekit.functions import bearing_deg, page_to_gps
from routekit.operators import fits as ft
from routekit.operators import graph as gr
from routekit.operators import linework as lw
from routekit.operators import output as out
from routekit.operators import placement as pl
from routekit.operators import quality as ql
from routekit.operators import sequence as sq
from routekit.operators.core import checkpoint, scratch_path
from routekit.plans.geometry import arcs, hits
from routekit.plans.graph import drawn_conns
from routekit.plans.quality import tiers
from routekit.plans.registry import query, r6, rounded
from routekit.plans.scalars import BRG, PAIR
from routekit.sources import cad, files


def steps_in(v):
    """GPS bearing of the step into each pole."""
    prev = v.tracks.selectExpr("route_id", "number + 1 AS number", "lat AS la", "lon AS lo")
    return v.tracks.join(prev, ["route_id", "number"]).select("route_id", "number", bearing_deg("la", "lo", "lat", "lon").alias("bearing"))


DEST = "asin(sin(radians({la})) * cos({m} / 6371000e0) + cos(radians({la})) * sin({m} / 6371000e0) * cos(radians({b})))"


def dest_sql(la, lo, b, m):
    p2 = DEST.format(la=la, m=m, b=b)
    return f"degrees({p2})", f"degrees(radians({lo}) + atan2(sin(radians({b})) * sin({m} / 6371000e0) * cos(radians({la})), cos({m} / 6371000e0) - sin(radians({la})) * sin({p2})))"


_S, _R = dest_sql("q.pla", "q.plo", "q.brg", "q.m"), dest_sql("r.lat", "r.lon", "q.brg", "q.m")


@query("q1_label_chain", f"""WITH RECURSIVE bg AS (SELECT route_id, number + 1 AS number, {BRG} AS brg FROM ({PAIR})),
 q AS (SELECT t.route_id, t.number, t.lat, t.lon, t.page, s.meters AS m, brg, p.lat AS pla, p.lon AS plo, coalesce(p.page <> t.page, true) AS first, t.page = 1 AS keep FROM v_tracks t LEFT JOIN v_spans s ON s.route_id = t.route_id AND s.hi = t.number AND s.meters > 0
   LEFT JOIN bg ON bg.route_id = t.route_id AND bg.number = t.number LEFT JOIN v_tracks p ON p.route_id = t.route_id AND p.number = t.number - 1),
 rc AS (SELECT route_id, number, lat, lon FROM q WHERE number = 1 UNION ALL SELECT q.route_id, q.number, CASE WHEN keep OR q.m IS NULL THEN q.lat WHEN first THEN {_S[0]} ELSE {_R[0]} END, CASE WHEN keep OR q.m IS NULL THEN q.lon WHEN first THEN {_S[1]} ELSE {_R[1]} END FROM q JOIN rc r ON r.route_id = q.route_id AND q.number = r.number + 1)
 SELECT route_id, number, round(lat, 8) AS lat, round(lon, 8) AS lon FROM rc""")
def _(v):
    runs = sq.split_runs(v.tracks, v.tracks.where("false"))
    return rounded(pl.label_chain(runs, v.spans, steps_in(v)), "lat", "lon", places=8)


def page_xf(v):
    return v.tracks.select("route_id", "page").distinct().selectExpr("route_id", "page", "700000e0 + route_id * 100 + page * 30 AS origin_e", "6900000e0 - page * 420 AS origin_n", "0.5e0 AS sx", "0.5e0 AS sy", "page * 0.02e0 AS theta")


@query("q2_lock_page_breaks")
def _(v):
    return rounded(pl.lock_page_breaks(page_xf(v), v.tracks, v.spans, steps_in(v)), "origin_e", "origin_n", places=4)


def located(v):
    return hits(v).select("route_id", "page", "number", "d", "path_id", "t")


def symbol_arcs(v):
    found = lw.nearest_on_cable(v.symbols.selectExpr("route_id", "page", "sym_id AS point_id", "x", "y"), arcs(v))
    return v.symbols.join(found.select("route_id", "page", F.col("point_id").alias("sym_id"), "t"), ["route_id", "page", "sym_id"])


def chosen(v):
    at = checkpoint(located(v))
    scale, direction = ft.drawn_scale(v.tracks, v.spans), lw.arc_direction(at)
    expected = sq.expected_arc(v.tracks, v.spans, at, scale, direction)
    poles = v.tracks.select("route_id", "page", "number", "x", "y").join(at.select("route_id", "page", "number", "t"), ["route_id", "page", "number"]).join(expected, ["route_id", "page", "number"], "left")
    return checkpoint(pl.topk_symbols(poles, symbol_arcs(v))), scale, direction


@query("o4_topk_symbols")
def _(v):
    return rounded(chosen(v)[0], "t", "d")


@query("q3_decode_path")
def _(v):
    cand, scale, direction = chosen(v)
    return rounded(pl.decode_path(cand, v.spans, scale, direction), "t")


@query("w20_repair_arc_jumps")
def _(v):
    at = checkpoint(located(v))
    poles = v.tracks.select("route_id", "page", "number", "x", "y").join(at.select("route_id", "page", "number", "path_id", "t"), ["route_id", "page", "number"])
    moved = poles.withColumn("t", F.when(F.col("number") % 6 == 0, F.col("t") + 70).otherwise(F.col("t")))
    return rounded(pl.repair_arc_jumps(moved, v.symbols, v.spans, arcs(v), ft.drawn_scale(v.tracks, v.spans), lw.arc_direction(at)), "d")


@query("q9_place_by_arc")
def _(v):
    at = checkpoint(located(v))
    return rounded(pl.place_by_arc(v.tracks, v.spans, arcs(v), at, ft.drawn_scale(v.tracks, v.spans), lw.arc_direction(at)), "x", "y")


@query("w21_mirror_pages")
def _(v):
    poles = v.tracks.select("route_id", "page", "number", "lat", F.when(F.col("page") % 2 == 0, F.col("lon") + 6e-4).otherwise(F.col("lon")).alias("lon"), (F.col("y") - 305).alias("side"))
    return rounded(pl.mirror_pages(poles, v.spans), "lat", "lon", places=8)


@query("w21_mirror_poles")
def _(v):
    return rounded(pl.mirror_poles(v.tracks.select("route_id", "page", "number", "x", "y", "lat", "lon")), "lat", "lon", places=8)


@query("w21_corridor_clamp")
def _(v):
    foot = v.tracks.where("source <> 'view'").selectExpr("route_id", "number", "lat + 5e-5 AS c_lat", "lon + v * 1e-6 AS c_lon")
    poles = v.tracks.select("route_id", "page", "number", "lat", "lon")
    return rounded(pl.corridor_clamp(poles, foot, v.spans, 3.0), "lat", "lon", places=8)


@query("q7_seam_similarity")
def _(v):
    turn = "page * 0.03e0"
    samples = v.tracks.selectExpr(
        "route_id", "page", "(number % 16) * 5e0 AS side_m", "e AS px", "n AS py", f"e * cos({turn}) + n * sin({turn}) + v / 100 AS qx", f"n * cos({turn}) - e * sin({turn}) - v / 200 AS qy")
    return rounded(pl.seam_similarity(samples).select("route_id", "page", "n", "scale", "theta", "accepted"), "scale", "theta")


@query("q4_fit_page_origins")
def _(v):
    anchors = v.tracks.where("number = 1").select("route_id", "page")
    return rounded(pl.fit_page_origins(page_xf(v), v.tracks, v.spans, anchors), "origin_e", "origin_n", "theta", "rmse0", "rmse", places=3)


@query("q12_propagate_positions")
def _(v):
    conns = v.spans.where("meters > 0").unionByName(v.jumps.where("source = 'bifurcation-main'")).selectExpr("route_id", "lo AS u", "hi AS v", "meters", "source")
    return rounded(pl.propagate_positions(conns, v.tracks.where("number = 1").select("route_id", "number", "e", "n"), v.tracks, v.base.select("route_id", "idx", "x", "y")), "e", "n", places=3)


@query("q13_propose_repairs")
def _(v):
    shifted = v.tracks.withColumn("e", F.when(F.col("number") % 9 == 0, F.col("e") + 24).otherwise(F.col("e")))
    estimate = v.tracks.selectExpr("route_id", "number", "e AS x", "n AS y")
    return rounded(pl.propose_repairs(shifted, v.spans, v.base.select("route_id", "idx", "x", "y"), estimate), "e", "n", "cost_before", "cost_after", places=4)


# ---------------------------------------------------------------- sources: text that Spark writes from the tables

def scratch(v, name):
    """A new folder beside the checkpoints."""
    return scratch_path(v.spark, name)


def cad_folder(v):
    pair = lambda code, value: F.concat(F.lit(f"{code}\n"), value)
    xy = lambda x, y: F.concat_ws("\n", pair(10, F.format_string("%.3f", F.col(x))), pair(20, F.format_string("%.3f", F.col(y))))
    frame = lambda *body: F.concat_ws("\n", F.lit("0\nSECTION\n2\nENTITIES"), *body, F.lit("0\nENDSEC"))
    poles = v.base.select(frame(F.lit("0\nINSERT\n8\nPoste"), pair(2, F.col("block")), xy("x", "y")).alias("value"))
    layer = F.when(F.col("kind") == "primary", "TrechoPrimarioAereo").otherwise("TrechoSecundarioAereo")
    lines = v.base_edges.select(frame(F.lit("0\nLWPOLYLINE"), pair(8, layer), xy("ax", "ay"), xy("bx", "by")).alias("value"))
    path = scratch(v, "cad")
    poles.unionByName(lines).write.text(path)
    return path


@query("s1_cad_entities", "SELECT block, round(x, 3) AS x, round(y, 3) AS y FROM v_base")
def _(v):
    return cad.pole_inserts(cad.read_cad_text(v.spark, cad_folder(v))).select("block", r6("x", 3).alias("x"), r6("y", 3).alias("y"))


@query("s2_polyline_edges", 'SELECT kind, round(ax, 3) AS ax, round(ay, 3) AS ay, round(bx, 3) AS bx, round("by", 3) AS by_ FROM v_base_edges')
def _(v):
    edges = cad.polyline_edges(cad.read_cad_text(v.spark, cad_folder(v)))
    return rounded(edges.select("kind", "ax", "ay", "bx", F.col("by").alias("by_")), "ax", "ay", "bx", "by_", places=3)


def truth_folder(v):
    text = F.when(F.col("source") == "error", F.concat(F.lit("Poste "), F.col("number").cast("string"), F.lit("; sem leitura;"))) \
        .otherwise(F.concat(F.lit("POSTE "), F.lpad(F.col("number").cast("string"), 2, "0"), F.lit("; "), F.format_string("%.6f", F.col("lat")), F.lit(", "), F.format_string("%.6f", F.col("lon")), F.lit(";")))
    path = scratch(v, "truth")
    v.tracks.select(text.alias("value")).write.text(path)
    return path


@query("s3_truth_text", "SELECT number, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_tracks WHERE source <> 'error'")
def _(v):
    return files.read_truth_text(v.spark, truth_folder(v)).select("number", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query("s4_dropped_lines", "SELECT count(*) AS expected, count(*) FILTER (source <> 'error') AS parsed, count(*) FILTER (source = 'error') AS dropped FROM v_tracks")
def _(v):
    return files.dropped_lines(files.read_text_lines(v.spark, truth_folder(v))).agg(F.sum("expected").alias("expected"), F.sum("parsed").alias("parsed"), F.sum("dropped").alias("dropped"))


@query("s5_json_table", "SELECT route_id, number, lat FROM v_truth WHERE lat IS NOT NULL")
def _(v):
    path = scratch(v, "json")
    v.truth.groupBy("route_id", F.floor(F.col("number") / 16).alias("block")).agg(F.collect_list(F.struct("number", "lat", "lon")).alias("posts")).drop("block").write.json(path)
    schema = "route_id bigint, posts array<struct<number:int,lat:double,lon:double>>"
    rows = files.read_json_table(v.spark, path, schema, multi_line=False)
    return rows.select("route_id", F.explode("posts").alias("p")).select("route_id", "p.number", "p.lat").where("lat IS NOT NULL")


@query("s6_primitives", "SELECT route_id, page, count(*) AS n_items, CAST(sum(x) AS DOUBLE) AS sx FROM v_labels GROUP BY 1, 2")
def _(v):
    path = scratch(v, "primitives")
    v.labels.select("route_id", "item_id", "page", F.lit("Distância_Poste").alias("layer"), "str", "x", "y", "width").write.parquet(f"{path}/text_items")
    v.path_ops.write.parquet(f"{path}/path_ops")
    items, _ops = files.read_primitives(v.spark, path)
    return items.groupBy("route_id", "page").agg(F.count("*").alias("n_items"), F.sum("x").alias("sx"))


@query("s11_write_results", "SELECT route_id, number, round(v, 6) AS v FROM v_tracks")
def _(v):
    path = scratch(v, "results")
    files.write_results(v.tracks.select("route_id", "number", "v"), path)
    return v.spark.read.schema("route_id bigint, number int, v double").parquet(path)


# ---------------------------------------------------------------- output

def placed(v):
    return v.tracks.withColumns({c: F.when(F.col("source") != "click", F.col(c)) for c in ("lat", "lon")})


@query("x1_pole_placemarks")
def _(v):
    return out.pole_placemarks(placed(v), tiers(v))


def map_lines(v):
    """The drawn lines of each document: redundant edges go, then edges with an end that has no position, then chains form."""
    conns = gr.drop_transitive(drawn_conns(v))
    seen = conns.join(out.skipped_edges(conns, placed(v)), ["route_id", "src", "dst"], "left_anti")
    return out.line_placemarks(gr.route_polylines(seen), placed(v)).withColumn("part", F.col("part").cast("long"))


@query("x2_line_placemarks")
def _(v):
    return map_lines(v)


@query("x3_unresolved", "SELECT route_id, number, concat('poste ', CASE WHEN number < 10 THEN '0' ELSE '' END, number, ' sem coordenada (não resolvido)') AS text FROM v_tracks WHERE source = 'click'")
def _(v):
    return out.unresolved(placed(v))


@query("x4_skipped_edges", """WITH k AS (SELECT route_id, number FROM v_tracks WHERE source <> 'click') SELECT DISTINCT route_id, lo AS src, hi AS dst FROM v_all_spans WHERE (route_id, lo) NOT IN (SELECT (route_id, number) FROM k) OR (route_id, hi) NOT IN (SELECT (route_id, number) FROM k)""")
def _(v):
    return out.skipped_edges(v.all_spans.selectExpr("route_id", "lo AS src", "hi AS dst"), placed(v))


def documents(v):
    blue = F.create_map(F.lit("lineColor"), F.lit("blue"))
    return v.tracks.select("route_id").distinct().withColumn("options", F.when(F.col("route_id") % 2 == 0, blue))


@query("x5_style_blocks")
def _(v):
    return out.style_blocks(documents(v))


@query("s10_write_kml")
def _(v):
    text = out.kml_lines(out.style_blocks(documents(v)), out.pole_placemarks(placed(v), tiers(v)), map_lines(v))
    path = scratch(v, "kml")
    files.write_kml(text, path)
    return files.read_kml(v.spark, path).groupBy("route_id").agg(F.count("*").alias("n_lines"))


WARN = "CASE route_id % 4 WHEN 0 THEN 'dwg-zone-mismatch' WHEN 1 THEN 'dwg-missing-distance' WHEN 2 THEN 'diverged-at-post' ELSE 'other-kind' END"


@query("p31_format_warnings", f"""SELECT route_id, number, CASE route_id % 4 WHEN 0 THEN concat('DWG: zona UTM ', number, ' ≠ esperada 22.') WHEN 1 THEN concat('DWG: distância ausente ', number, '→', number + 1, '.')
 WHEN 2 THEN concat('DXF: rota divergiu no poste ', number, ' (resíduo ? m).') ELSE 'DWG: other-kind' END AS text FROM v_tracks""")
def _(v):
    n = F.col("number").cast("string")
    args = F.create_map(F.lit("got"), n, F.lit("expected"), F.lit("22"), F.lit("from"), n, F.lit("to"), (F.col("number") + 1).cast("string"), F.lit("at_post"), n)
    return out.format_warnings(v.tracks.select("route_id", "number", F.expr(WARN).alias("kind"), args.alias("args"))).select("route_id", "number", "text")


@query("j7_overrides_json", "SELECT route_id, number AS lo, number + 1 AS hi, round(v, 2) AS meters FROM v_tracks WHERE v > 0")
def _(v):
    body = F.concat(F.lit('{"'), F.col("number").cast("string"), F.lit("->"), (F.col("number") + 1).cast("string"), F.lit('": '), F.col("v").cast("string"), F.lit("}"))
    return rounded(files.overrides_from_json(v.tracks.select("route_id", body.alias("body"))), "meters", places=2)
