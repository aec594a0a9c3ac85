"""Cable linework: flattening, arc length, nearest points, grid lines."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routekit.functions import dist2d, point_segment, rotate
from routekit.operators.core import chunked_fold, nearest, number_chunk, ordered_scan, radius_pairs, true_median, value_chunk

PATH = ["route_id", "page", "path_id"]
PAGE = ["route_id", "page"]
# Straight steps per curve kind; distances in page points.
CURVE_STEPS = {"C": 10, "Q": 8, "L": 1, "Z": 1}
OFF_CABLE_PT, ARC_PAD_PT, NEAR_CABLE_PT, TANGENT_PT = 30.0, 20.0, 80.0, 3.0
FRAGMENTED_SUBPATHS = 5


def flatten_curves(path_ops: DataFrame) -> DataFrame:
    """Straight segments (route_id, page, path_id, seq, k, ax, ay, bx, by) of M/L/C/Q/Z operators."""
    point = F.struct("x", "y")
    started = ordered_scan(path_ops, PATH, "seq", chunk=number_chunk("seq"), last={"_start": F.when(F.col("op") == "M", point)})
    placed = started.withColumn("_p", F.when(F.col("op") == "Z", F.col("_start")).otherwise(point))
    linked = ordered_scan(placed, PATH, "seq", chunk=number_chunk("seq"), lag={"_q": "_p"})
    steps = F.when(F.col("op") == "M", 0)
    for op, n in CURVE_STEPS.items():
        steps = steps.when(F.col("op") == op, n)
    drawn = linked.withColumn("_n", steps).where((F.col("_n") > 0) & F.col("_q").isNotNull())

    def at(t: Column, axis: str) -> Column:
        start, end, c1, c2, u = F.col(f"_q.{axis}"), F.col(f"_p.{axis}"), F.col(f"{axis}1"), F.col(f"{axis}2"), 1 - t
        cubic = u * u * u * start + 3 * u * u * t * c1 + 3 * u * t * t * c2 + t * t * t * end
        square = u * u * start + 2 * u * t * c1 + t * t * end
        return F.when(F.col("op") == "C", cubic).when(F.col("op") == "Q", square).otherwise(start + t * (end - start))

    cut = drawn.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    before, after = (F.col("k") - 1) / F.col("_n"), F.col("k") / F.col("_n")
    return cut.select(*PATH, "seq", "k", at(before, "x").alias("ax"), at(before, "y").alias("ay"),
                      at(after, "x").alias("bx"), at(after, "y").alias("by"))


def with_arc(segs: DataFrame) -> DataFrame:
    """Add len and cum0, the path length before each segment. Segments without k get k = 1."""
    if "k" not in segs.columns:
        segs = segs.withColumn("k", F.lit(1))
    measured = segs.withColumn("len", dist2d("ax", "ay", "bx", "by"))
    summed = ordered_scan(measured, PATH, ["seq", "k"], chunk=number_chunk("seq"), cumsum={"_upto": "len"})
    return summed.withColumn("cum0", F.col("_upto") - F.col("len")).drop("_upto")


def cable_table(path_ops: DataFrame) -> DataFrame:
    """One row per path: first and last drawn point, operator count."""
    point = F.when(F.col("op").isin("M", "L"), F.struct("x", "y"))
    at = F.when(F.col("op").isin("M", "L"), F.col("seq"))
    return path_ops.groupBy(*PATH).agg(F.min_by(point, at).alias("start"), F.max_by(point, at).alias("end"), F.count("*").alias("n_ops"))


def path_stats(path_ops: DataFrame) -> DataFrame:
    """Length, subpath count and fragmented flag per path."""
    subpaths = path_ops.groupBy(*PATH).agg(F.count_if(F.col("op") == "M").alias("subpaths"))
    lengths = flatten_curves(path_ops).groupBy(*PATH).agg(F.sum(dist2d("ax", "ay", "bx", "by")).alias("length"))
    return (subpaths.join(lengths, PATH, "left").fillna({"length": 0.0})
            .withColumn("fragmented", F.col("subpaths") >= FRAGMENTED_SUBPATHS))


def nearest_on_cable(points: DataFrame, segs: DataFrame, *, start: float = 64.0, limit: float | None = None) -> DataFrame:
    """Nearest cable point of each point on its page: (route_id, page, point_id, d, path_id, x, y, t).

    segs come from with_arc. Long segments are cut so that rings of small cells find them by their middle.
    """
    piece = start / 2
    cut = (segs.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("len") / piece).cast("int")))
           .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))))
    mid = (F.col("_i") + 0.5) / F.col("_n")
    targets = cut.select(*PAGE, F.struct("path_id", "seq", "k", "_i").alias("rid"),
                         (F.col("ax") + mid * (F.col("bx") - F.col("ax"))).alias("rx"),
                         (F.col("ay") + mid * (F.col("by") - F.col("ay"))).alias("ry"), "ax", "ay", "bx", "by", "len", "cum0")

    def refine(pairs):
        hit = pairs.withColumn("_h", point_segment("lx", "ly", "ax", "ay", "bx", "by"))
        return hit.withColumns({"d": F.col("_h.d"), "x": F.col("_h.x"), "y": F.col("_h.y"), "t": F.col("cum0") + F.col("_h.t") * F.col("len")})

    left = points.selectExpr("route_id", "page", "point_id AS lid", "x AS lx", "y AS ly")
    best = nearest(left, targets, PAGE, start=start, limit=limit, payload=("x", "y", "t"), slack=piece, refine=refine)
    return best.select(*PAGE, F.col("lid").alias("point_id"), "d", F.col("rid.path_id").alias("path_id"), "x", "y", "t")


def point_at_arc(segs: DataFrame, targets: DataFrame, bucket: float = 256.0) -> DataFrame:
    """Point at arc length t on a path, clamped to its end: targets (route_id, page, path_id, target_id, t) + px, py.

    A segment is filed under every arc bucket it crosses, so a target meets only the segments near its arc.
    """
    ends = F.col("cum0") + F.col("len")
    totals = segs.groupBy(*PATH).agg(F.max(ends).alias("_total"))
    filed = segs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("cum0") / bucket), F.floor(ends / bucket))))
    asked = (targets.where("t >= 0").join(totals, PATH).withColumn("_t", F.least("t", "_total"))
             .withColumn("_b", F.floor(F.col("_t") / bucket)))
    met = asked.join(filed.select(*PATH, "_b", "seq", "k", "ax", "ay", "bx", "by", "len", "cum0"), [*PATH, "_b"])
    met = met.where((F.col("_t") >= F.col("cum0")) & (F.col("_t") <= ends))
    f = F.when(F.col("len") < 1e-12, 0.0).otherwise((F.col("_t") - F.col("cum0")) / F.col("len"))
    at = F.struct((F.col("ax") + f * (F.col("bx") - F.col("ax"))).alias("px"), (F.col("ay") + f * (F.col("by") - F.col("ay"))).alias("py"))
    return (met.groupBy(*PATH, "target_id").agg(F.min_by(at, F.struct("seq", "k")).alias("_p"), F.first("t").alias("t"))
            .select(*PATH, "target_id", "t", "_p.*"))


def tangent_bearings(segs: DataFrame, targets: DataFrame) -> DataFrame:
    """Cable direction at arc t, looking along `direction` (+1 or -1): adds bearing."""
    totals = segs.groupBy(*PATH).agg(F.max(F.col("cum0") + F.col("len")).alias("_total"))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.col("_total"), c))
    rows = targets.join(totals, PATH).withColumn("t0", clamp(F.col("t")))
    rows = rows.withColumn("t1", clamp(F.col("t0") + F.col("direction") * TANGENT_PT))
    both = rows.select(*PATH, F.col("target_id").alias("_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("e"), F.col("t0").alias("t")), F.struct(F.lit(1).alias("e"), F.col("t1").alias("t")))).alias("_s"))
    found = point_at_arc(segs, both.select(*PATH, F.struct("_id", "_s.e").alias("target_id"), F.col("_s.t").alias("t")))
    pick = lambda e, c: F.max(F.when(F.col("target_id.e") == e, F.col(c)))
    ends = found.groupBy(*PATH, F.col("target_id._id").alias("target_id")).agg(
        *[pick(e, c).alias(f"{c}{e}") for e in (0, 1) for c in ("px", "py")])
    bearing = F.pmod(F.degrees(F.atan2(F.col("px1") - F.col("px0"), F.col("py0") - F.col("py1"))) + 360, F.lit(360.0))
    return targets.join(ends.select(*PATH, "target_id", bearing.alias("bearing")), [*PATH, "target_id"], "left")


def cable_between(hits: DataFrame, segs: DataFrame) -> DataFrame:
    """Arc length and mid-span direction between poles N and N+1 on one path. hits: route_id, number, page, path_id, d, t."""
    near = hits.where(F.col("d") <= NEAR_CABLE_PT)
    nxt = near.selectExpr("route_id", "page", "path_id", "number - 1 AS number", "t AS t_next")
    pairs = near.join(nxt, [*PATH, "number"])
    asked = pairs.select(*PATH, "number", "t", "t_next", F.abs(F.col("t_next") - F.col("t")).alias("arc_pt"))
    targets = asked.select(*PATH, F.col("number").alias("target_id"), ((F.col("t") + F.col("t_next")) / 2).alias("t"),
                           F.when(F.col("t_next") >= F.col("t"), 1).otherwise(-1).alias("direction"))
    found = tangent_bearings(segs, targets)
    return (asked.drop("t", "t_next").join(found.select(*PATH, F.col("target_id").alias("number"), "bearing"), [*PATH, "number"], "left"))


def exit_bearings(hits: DataFrame, segs: DataFrame) -> DataFrame:
    """Cable direction leaving the page at its last pole."""
    last = hits.groupBy(*PAGE).agg(F.max_by(F.struct("number", "path_id", "d", "t"), "number").alias("_h")).select(*PAGE, "_h.*")
    totals = segs.groupBy(*PATH).agg(F.max(F.col("cum0") + F.col("len")).alias("_total"))
    ahead = F.when(F.col("t") >= F.col("_total") * 0.5, 1).otherwise(-1)
    targets = last.where(F.col("d") <= NEAR_CABLE_PT).join(totals, PATH).select(*PATH, F.col("number").alias("target_id"), "t", ahead.alias("direction"))
    return tangent_bearings(segs, targets).select(*PATH, F.col("target_id").alias("number"), "bearing")


def tap_poles(hits: DataFrame) -> DataFrame:
    """Add is_tap: on the cable, but its arc lies outside that of poles N-1 and N+1 (same page and path)."""
    side = lambda shift, name: hits.selectExpr("route_id", "page", "path_id", f"number + {shift} AS number", f"t AS {name}")
    rows = hits.join(side(1, "_tp"), [*PATH, "number"], "left").join(side(-1, "_tn"), [*PATH, "number"], "left")
    low, high = F.least("_tp", "_tn") - ARC_PAD_PT, F.greatest("_tp", "_tn") + ARC_PAD_PT
    outside = (F.col("t") < low) | (F.col("t") > high)
    both = F.col("_tp").isNotNull() & F.col("_tn").isNotNull()
    return rows.withColumn("is_tap", both & (F.col("d") <= OFF_CABLE_PT) & outside).drop("_tp", "_tn")


def arc_direction(hits: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """+1 or -1 per page: does the arc grow with the number?

    With chain (route_id, page, chain_pt), the drawn-to-printed length decides when one direction is 8 pt better.
    """
    base = hits.groupBy(*PAGE).agg(F.regr_slope("t", "number").alias("_s"), F.min_by("t", "number").alias("_t0"), F.max_by("t", "number").alias("_t1"))
    initial = F.when(F.coalesce(F.col("_s"), F.lit(0.0)) < 0, -1).otherwise(1)
    if chain is None:
        return base.select(*PAGE, initial.alias("direction"))
    plus = F.abs(F.col("_t0") + F.col("chain_pt") - F.col("_t1"))
    minus = F.abs(F.col("_t0") - F.col("chain_pt") - F.col("_t1"))
    return base.join(chain, PAGE, "left").select(
        *PAGE, F.when(minus + 8 < plus, -1).when(plus + 8 < minus, 1).otherwise(initial).alias("direction"))


def pick_route_cable(points: DataFrame, segs: DataFrame, max_pt: float = NEAR_CABLE_PT) -> DataFrame:
    """Best path per page for a reference point: long arc, near the point (score t - 2d), within max_pt.

    points: (route_id, page, x, y), one per page. Every path is a candidate, so each path's own nearest point is taken.
    """
    hit = (points.join(segs, PAGE).withColumn("_h", point_segment("x", "y", "ax", "ay", "bx", "by"))
           .groupBy(*PATH).agg(F.min(F.struct(F.col("_h.d").alias("d"), (F.col("cum0") + F.col("_h.t") * F.col("len")).alias("t"))).alias("_b"))
           .select(*PATH, "_b.*").where(F.col("d") <= max_pt))
    return hit.groupBy(*PAGE).agg(F.max_by(F.struct("path_id", "d", "t"), F.struct(F.col("t") - 2 * F.col("d"), -F.col("path_id"))).alias("_b")).select(*PAGE, "_b.*")


def touching_segments(cables: DataFrame, tol: float = 5.0, by=("route_id", "page")) -> DataFrame:
    """Pairs of paths whose end points lie closer than tol. cables: by..., path_id, start, end."""
    ends = cables.select(*by, "path_id", F.explode(F.array("start", "end")).alias("p")).where("p IS NOT NULL")
    spots = ends.select(*by, "path_id", "p.x", "p.y").distinct()
    left = spots.select(*by, F.col("path_id").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = spots.select(*by, F.col("path_id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return (radius_pairs(left, right, tol, by).where("lid < rid").where(F.col("d") < tol)
            .select(*by, F.col("lid").alias("path_a"), F.col("rid").alias("path_b")).distinct())


def classify_grid_lines(segs: DataFrame, theta: float = 0.0, tol: float = 2.0, min_len: float = 2.0) -> DataFrame:
    """Horizontal (axis h, pos y) and vertical (axis v, pos x) grid lines after de-rotation by theta."""
    a, b = rotate("ax", "ay", -theta), rotate("bx", "by", -theta)
    rows = segs.withColumns({"_a": a, "_b": b})
    dx, dy = F.abs(F.col("_b.x") - F.col("_a.x")), F.abs(F.col("_b.y") - F.col("_a.y"))
    axis = F.when((dy <= tol) & (dx > dy), "h").when((dx <= tol) & (dy > dx), "v")
    rows = rows.where(F.sqrt(dx * dx + dy * dy) >= min_len).withColumn("axis", axis).where("axis IS NOT NULL")
    pos = F.when(F.col("axis") == "h", (F.col("ay") + F.col("by")) / 2).otherwise((F.col("ax") + F.col("bx")) / 2)
    return rows.withColumn("pos", pos).drop("_a", "_b")


def grid_spacing(lines: DataFrame, by=("route_id", "page", "axis")) -> DataFrame:
    """Median gap above 5 pt between sorted line positions, per axis."""
    by = list(by)
    spaced = ordered_scan(lines.select(*by, "pos").distinct(), by, "pos", chunk=value_chunk("pos", 4096.0), lag={"_prev": "pos"})
    gaps = spaced.withColumn("_gap", F.col("pos") - F.col("_prev")).where("_gap > 5")
    return true_median(gaps, by, "_gap", "spacing", width=64.0).drop("n")


def grid_scale(lines: DataFrame, metres: float = 50.0) -> DataFrame:
    """Metres per point of a page, from its grid spacing; null outside 5..5000 pt."""
    spacing = grid_spacing(lines).groupBy(*PAGE).agg(F.avg("spacing").alias("spacing"))
    return spacing.withColumn("scale", F.when(F.col("spacing").between(5, 5000), metres / F.col("spacing")))


def dedupe_positions(lines: DataFrame, by, tol: float = 2.0, pos: str = "pos") -> DataFrame:
    """Drop positions within tol of the last kept one, in ascending order."""
    by = [by] if isinstance(by, str) else list(by)
    distinct = lines.select(*by, pos).distinct()
    kept = chunked_fold(
        distinct, by, pos, fields=[], zero=F.struct(F.lit(None).cast("double").alias("last"), F.lit(False).alias("keep")),
        step=lambda s, r: F.when(s["last"].isNull() | (r[pos] - s["last"] > tol), F.struct(r[pos].alias("last"), F.lit(True).alias("keep")))
        .otherwise(F.struct(s["last"].alias("last"), F.lit(False).alias("keep"))),
        emit=lambda s, r: F.struct(r[pos].alias(pos), s["keep"].alias("_keep")), chunk=value_chunk(pos, 512.0))
    return kept.where("_keep").drop("_keep")


def grid_control_points(lines: DataFrame, metres: float = 50.0) -> DataFrame:
    """Grid crossings with metres relative to the first line of each axis: (route_id, page, x, y, e_rel, n_rel).

    Lines are thinned to 2 pt first, so a page has at most page-extent/2 lines per axis and the crossing list, which
    is the result itself, is bounded by the page size.
    """
    thin = dedupe_positions(lines, [*PAGE, "axis"])
    stats = thin.groupBy(*PAGE, "axis").agg(F.count("*").alias("n"), F.min("pos").alias("p0")).where("n >= 2")
    ready = thin.join(stats, [*PAGE, "axis"]).join(grid_spacing(thin), [*PAGE, "axis"])
    rel = (F.col("pos") - F.col("p0")) / F.col("spacing") * metres
    v = ready.where("axis = 'v'").select(*PAGE, F.col("pos").alias("x"), rel.alias("e_rel"))
    h = ready.where("axis = 'h'").select(*PAGE, F.col("pos").alias("y"), rel.alias("n_rel"))
    return v.join(h, PAGE)


def dominant_orientation(segs: DataFrame, min_n: int = 10, by=("route_id", "page")) -> DataFrame:
    """Length-weighted mean direction of near-horizontal linework; 0 for few segments or under one degree."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = dist2d("ax", "ay", "bx", "by")
    use = (length >= 2) & (F.abs(dx) >= 0.35 * F.abs(dy))
    sums = segs.groupBy(*by).agg(F.count_if(use).alias("_n"), F.sum(F.when(use, dx)).alias("_c"), F.sum(F.when(use, dy)).alias("_s"))
    theta = F.atan2("_s", "_c")
    return sums.select(*by, F.when((F.col("_n") >= min_n) & (F.abs(theta) >= math.radians(1)), theta).otherwise(0.0).alias("theta"))


def dedupe_vertices(polyline: DataFrame, by=("route_id", "path_id"), tol: float = 0.5) -> DataFrame:
    """Drop a vertex closer than tol to one of the last three kept vertices. polyline: by..., seq, x, y."""
    point = "array<struct<x:double,y:double>>"

    def step(state, row):
        here = F.struct(row["x"].cast("double").alias("x"), row["y"].cast("double").alias("y"))
        recent = F.slice(state["kept"], F.greatest(F.lit(1), F.size(state["kept"]) - 2), 3)
        close = F.exists(recent, lambda q: dist2d(q["x"], q["y"], row["x"], row["y"]) < tol)
        return F.struct(F.when(close, recent).otherwise(F.concat(recent, F.array(here))).alias("kept"), (~close).alias("keep"))

    kept = chunked_fold(polyline, list(by), "seq", fields=["x", "y"], step=step,
                        zero=F.struct(F.array().cast(point).alias("kept"), F.lit(False).alias("keep")),
                        emit=lambda s, r: F.struct(r["seq"].alias("seq"), r["x"].alias("x"), r["y"].alias("y"), s["keep"].alias("_keep")))
    return kept.where("_keep").drop("_keep")


def kinks(polyline: DataFrame, by=("route_id", "path_id"), min_deg: float = 20.0) -> DataFrame:
    """Vertices where the line turns by at least min_deg, with their arc position. polyline: by..., seq, x, y."""
    by = list(by)
    here = F.struct("x", "y")
    rows = ordered_scan(polyline, by, "seq", chunk=number_chunk("seq"), lag={"_p": here}, lead={"_q": here})
    step = F.coalesce(dist2d("x", "y", "_p.x", "_p.y"), F.lit(0.0))
    rows = ordered_scan(rows.withColumn("_step", step), by, "seq", chunk=number_chunk("seq"), cumsum={"arc": "_step"})
    ix, iy, ox, oy = F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y"), F.col("_q.x") - F.col("x"), F.col("_q.y") - F.col("y")
    norm = F.sqrt(ix * ix + iy * iy) * F.sqrt(ox * ox + oy * oy)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ix * ox + iy * oy) / F.nullif(norm, F.lit(0.0))))
    return rows.withColumn("turn_deg", F.degrees(F.acos(cosine))).where(F.col("turn_deg") >= min_deg).drop("_p", "_q", "_step")


def stitch_dashes(path_ops: DataFrame, axis: DataFrame) -> DataFrame:
    """One ordered spine per fragmented path: the middle of each dash's longest segment, along the route axis.

    axis: (route_id, page, ref_x, ref_y, ux, uy). Result: path key, rank-free order column `along`, x, y.
    """
    subpath = ordered_scan(path_ops, PATH, "seq", chunk=number_chunk("seq"), cumsum={"dash": F.when(F.col("op") == "M", 1).otherwise(0)})
    broken = subpath.groupBy(*PATH).agg(F.max("dash").alias("_n")).where(F.col("_n") >= FRAGMENTED_SUBPATHS).select(*PATH)
    point = F.struct("x", "y")
    linked = ordered_scan(subpath, PATH, "seq", chunk=number_chunk("seq"), lag={"_q": point}).join(broken, PATH, "left_semi")
    line = F.col("op") == "L"
    mid = F.struct(((F.col("x") + F.col("_q.x")) / 2).alias("x"), ((F.col("y") + F.col("_q.y")) / 2).alias("y"))
    first = F.min_by(point, F.when(F.col("op").isin("M", "L"), F.col("seq")))
    spine = linked.groupBy(*PATH, "dash").agg(
        F.coalesce(F.max_by(F.when(line, mid), F.when(line, F.struct(dist2d("x", "y", "_q.x", "_q.y"), -F.col("seq")))), first).alias("_m"))
    along = (F.col("_m.x") - F.col("ref_x")) * F.col("ux") + (F.col("_m.y") - F.col("ref_y")) * F.col("uy")
    return spine.join(axis, PAGE).select(*PATH, "dash", along.alias("along"), "_m.x", "_m.y")
