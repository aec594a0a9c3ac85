"""Spatial matching: markers to symbols, labels to poles, poles to the regional base."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routekit.functions import dist2d, point_segment, pole_type, text_anchor
from routekit.operators.core import assign_1to1, checkpoint, greedy_pairs, knn, nearest, number_chunk, ordered_scan, radius_pairs, union_all

PAGE = ["route_id", "page"]
# Distances in page points, candidate caps.
BELOW_MIN_PT, BELOW_MAX_PT, ASIDE_MAX_PT = 1.0, 150.0, 130.0
HOP_GROWTH, MAX_CANDIDATES = 0.25, 30
JUMP_MIN_PT, GAP_VERTEX_PT = 100.0, 50.0


def side(df: DataFrame, prefix: str, id_col, x="x", y="y", by=PAGE, extra=()) -> DataFrame:
    """Rename to the (lid,lx,ly) / (rid,rx,ry) shape of the spatial joins."""
    return df.select(*by, F.col(id_col).alias(f"{prefix}id"), F.col(x).alias(f"{prefix}x"), F.col(y).alias(f"{prefix}y"), *extra)


def near_segments(points: DataFrame, segs: DataFrame, radius: float, by=PAGE, piece: float = 64.0) -> DataFrame:
    """All (point, segment) pairs within radius: by..., point_id, seg_id, d, t. Segments may be single points.

    Long segments are cut into pieces found by their middle; the distance is taken to the whole segment.
    """
    by = list(by)
    length = dist2d("ax", "ay", "bx", "by")
    cut = (segs.withColumn("_n", F.greatest(F.lit(1), F.ceil(length / piece).cast("int")))
           .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))))
    mid = (F.col("_i") + 0.5) / F.col("_n")
    right = cut.select(*by, F.col("seg_id").alias("rid"), (F.col("ax") + mid * (F.col("bx") - F.col("ax"))).alias("rx"),
                       (F.col("ay") + mid * (F.col("by") - F.col("ay"))).alias("ry"), "ax", "ay", "bx", "by")
    left = side(points, "l", "point_id", by=by)
    pairs = radius_pairs(left, right, radius + piece / 2, by).withColumn("_h", point_segment("lx", "ly", "ax", "ay", "bx", "by"))
    return (pairs.where(F.col("_h.d") <= radius).groupBy(*by, F.col("lid").alias("point_id"), F.col("rid").alias("seg_id"))
            .agg(F.first("_h.d").alias("d"), F.first("_h.t").alias("t")))


def attach_nearest_below(poles: DataFrame, items: DataFrame, dy=(BELOW_MIN_PT, BELOW_MAX_PT), dx: float = ASIDE_MAX_PT) -> DataFrame:
    """Pole type of the nearest type label in the box below the pole: adds pole_type. poles: route_id, page, row_id, x, y."""
    labels = items.withColumn("_type", pole_type("str")).where("_type IS NOT NULL").withColumn("_ax", text_anchor("x", "width"))
    reach = (dy[1] ** 2 + dx ** 2) ** 0.5
    pairs = radius_pairs(side(poles, "l", "row_id"), side(labels, "r", "item_id", "_ax", "y", extra=["_type"]), reach, PAGE)
    inside = (F.col("ry") - F.col("ly")).between(*dy) & (F.abs(F.col("rx") - F.col("lx")) <= dx)
    best = pairs.where(inside).groupBy(*PAGE, F.col("lid").alias("row_id")).agg(F.min_by("_type", F.struct("d", "rid")).alias("pole_type"))
    return poles.join(best, [*PAGE, "row_id"], "left")


def correlate_text(items: DataFrame, runs: DataFrame, tol: float = 5.0) -> DataFrame:
    """Layer of the nearest positioned text run closer than tol: adds run_layer. runs: route_id, page, run_id, layer, x, y."""
    pairs = radius_pairs(side(items, "l", "item_id"), side(runs, "r", "run_id", extra=["layer"]), tol, PAGE).where(F.col("d") < tol)
    best = pairs.groupBy(*PAGE, F.col("lid").alias("item_id")).agg(F.min_by("layer", F.struct("d", "rid")).alias("run_layer"))
    return items.join(best, [*PAGE, "item_id"], "left")


def nearest_poles(labels: DataFrame, poles: DataFrame, k: int = 4) -> DataFrame:
    """The k nearest poles of each label on its page: route_id, page, item_id, number, d, rank."""
    found = knn(side(labels, "l", "item_id"), side(poles, "r", "number"), k, PAGE, start=64.0)
    return found.select(*PAGE, F.col("lid").alias("item_id"), F.col("rid").alias("number"), "d", "rank")


def snap_markers(markers: DataFrame, symbols: DataFrame, max_d: float = 150.0) -> DataFrame:
    """Move markers onto pole symbols, one to one: route_id, page, mark_id, x, y, snapped."""
    pairs = assign_1to1(side(markers, "l", "mark_id"), side(symbols, "r", "sym_id"), PAGE, max_d=max_d)
    at = symbols.select(*PAGE, F.col("sym_id").alias("rid"), F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    won = pairs.join(at, [*PAGE, "rid"]).select(*PAGE, F.col("lid").alias("mark_id"), "_sx", "_sy")
    return markers.join(won, [*PAGE, "mark_id"], "left").select(
        *PAGE, "mark_id", F.coalesce("_sx", "x").alias("x"), F.coalesce("_sy", "y").alias("y"), F.col("_sx").isNotNull().alias("snapped"))


def widen_retry(left: DataFrame, right: DataFrame, radii=(60.0, 150.0), by=PAGE) -> DataFrame:
    """Nearest target within the first radius; rows without one try the next radius: by..., lid, rid, d, radius."""
    todo, parts = left, []
    for i, radius in enumerate(radii):
        hit = checkpoint(nearest(todo, right, by, start=radius, limit=radius).withColumn("radius", F.lit(float(radius))))
        parts.append(hit)
        if i + 1 < len(radii):
            todo = checkpoint(todo.join(hit.select(*by, "lid"), [*by, "lid"], "left_anti"))
    return union_all(parts)


def fallback_positions(poles: DataFrame, markers: DataFrame, symbols: DataFrame) -> DataFrame:
    """On routes without any pole symbol, take the marker position of the same number: adds x, y, source."""
    bare = poles.join(symbols.select("route_id").distinct(), "route_id", "left_anti").select("route_id").distinct()
    spare = markers.join(bare, "route_id", "left_semi").select("route_id", "number", F.col("x").alias("_mx"), F.col("y").alias("_my"))
    rows = poles.join(spare, ["route_id", "number"], "left")
    return (rows.withColumns({"source": F.when(F.col("_mx").isNotNull(), "marker").otherwise("symbol"),
                              "x": F.coalesce("_mx", "x"), "y": F.coalesce("_my", "y")}).drop("_mx", "_my"))


def merge_candidates(a: DataFrame, b: DataFrame, key=("route_id", "number", "rid")) -> DataFrame:
    return a.unionByName(b).dropDuplicates(list(key))


# ---------------------------------------------------------------- numbering jumps and gaps

def numbering_jumps(poles: DataFrame, min_pt: float = JUMP_MIN_PT) -> DataFrame:
    """Branch starts: a number gap with a jump of over 100 pt, and the nearest earlier pole as its junction."""
    poles = checkpoint(poles.select("route_id", "number", "x", "y"))  # read for the neighbours and as places to join
    rows = ordered_scan(poles, "route_id", "number", chunk=number_chunk(), lag={"_p": F.struct("number", "x", "y")})
    jump = rows.where((F.col("number") - F.col("_p.number") > 1) & (dist2d("x", "y", "_p.x", "_p.y") > min_pt))
    left, right = side(jump, "l", "number", by=["route_id"]), side(poles, "r", "number", by=["route_id"])
    hit = nearest(left, right, ["route_id"], start=64.0, refine=lambda p: p.where("rid < lid"))
    return hit.select("route_id", F.col("lid").alias("start"), F.col("rid").alias("junction"), F.col("d").alias("junction_pt"))


def route_topology(poles: DataFrame) -> DataFrame:
    """Branches of a route: start, end and junction number; the main route is the part before the first start."""
    starts = numbering_jumps(poles)
    marked = poles.select("route_id", "number").join(starts.select("route_id", F.col("start").alias("number"), F.col("start")), ["route_id", "number"], "left")
    grouped = ordered_scan(marked, "route_id", "number", chunk=number_chunk(), cummax={"branch": "start"})
    ends = grouped.groupBy("route_id", F.coalesce("branch", F.lit(0)).alias("start")).agg(
        F.min("number").alias("first_number"), F.max("number").alias("end"), F.count("*").alias("n"))
    return ends.join(starts.select("route_id", "start", "junction"), ["route_id", "start"], "left").select("route_id", "start", "end", "junction", "n")


def detect_gaps(poles: DataFrame, spans: DataFrame, vertices: DataFrame, radius: float = GAP_VERTEX_PT, branches: DataFrame | None = None) -> DataFrame:
    """Consecutive poles that no cable joins and no label measures: route_id, lo, hi.

    vertices: route_id, page, path_id, x, y of the drawn cables. A path joins a pair when it has a vertex near both.
    """
    linked = ordered_scan(poles.select(*PAGE, "number", "x", "y"), "route_id", "number", chunk=number_chunk(), lead={"_n": F.struct("number", "x", "y")})
    pairs = linked.where("_n IS NOT NULL").select(*PAGE, F.col("number").alias("lo"), F.col("_n.number").alias("hi"), "x", "y", "_n")
    if branches is not None:
        pairs = pairs.join(branches.select("route_id", F.col("start").alias("hi")), ["route_id", "hi"], "left_anti")
    ends = pairs.select(*PAGE, F.explode(F.array(
        F.struct(F.struct("lo", F.lit(0).alias("side")).alias("id"), F.col("x").alias("x"), F.col("y").alias("y")),
        F.struct(F.struct("lo", F.lit(1).alias("side")).alias("id"), F.col("_n.x").alias("x"), F.col("_n.y").alias("y")))).alias("p")).select(*PAGE, "p.*")
    near = (radius_pairs(side(ends, "l", "id"), side(vertices, "r", "path_id"), radius, PAGE).where(F.col("d") < radius)
            .select("route_id", "lid.lo", "lid.side", F.col("rid").alias("path_id")).distinct())
    joined = near.where("side = 0").drop("side").join(near.where("side = 1").drop("side"), ["route_id", "lo", "path_id"], "left_semi").select("route_id", "lo").distinct()
    labelled = spans.where(F.col("meters") > 0).select("route_id", "lo", "hi")
    return (pairs.select("route_id", "lo", "hi").join(joined, ["route_id", "lo"], "left_anti").join(labelled, ["route_id", "lo", "hi"], "left_anti"))


# ---------------------------------------------------------------- regional base

def assign_in_order(left: DataFrame, right: DataFrame, by=(), *, max_d: float) -> DataFrame:
    """Lefts in id order each take their nearest free right within max_d: by..., lid, rid, d."""
    pairs = radius_pairs(left, right, max_d, by).withColumnRenamed("d", "cost").select(*by, "lid", "rid", "cost")
    return greedy_pairs(pairs, by, left_rank=("cost", "rid", "lid"), right_rank=("lid", "cost", "rid")).withColumnRenamed("cost", "d")


def lift_topology(poles: DataFrame, region_poles: DataFrame, adj: DataFrame, max_m: float = 25.0) -> DataFrame:
    """Base-map cable neighbours in terms of pole numbers: route_id, number, neighbour.

    poles: route_id, region_id, number, e, n; adj: region_id, u, v. Routes with under three mapped poles give nothing.
    """
    left = poles.select("route_id", "region_id", F.col("number").alias("lid"), F.col("e").alias("lx"), F.col("n").alias("ly"))
    wanted = poles.select("route_id", "region_id").distinct()
    reach = poles.groupBy("route_id", "region_id").agg((F.min("e") - max_m).alias("_x0"), (F.max("e") + max_m).alias("_x1"), (F.min("n") - max_m).alias("_y0"), (F.max("n") + max_m).alias("_y1"))
    base = region_poles.select("region_id", F.col("idx").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = (radius_pairs(left, base, max_m, ["region_id"]).withColumnRenamed("d", "cost").select("route_id", "region_id", "lid", "rid", "cost"))
    got = greedy_pairs(pairs, ["route_id", "region_id"], left_rank=("cost", "rid", "lid"), right_rank=("lid", "cost", "rid"))
    enough = got.groupBy("route_id").agg(F.count("*").alias("_k")).where("_k >= 3").select("route_id")
    got = got.join(enough, "route_id", "left_semi")
    a = got.select("route_id", "region_id", F.col("rid").alias("u"), F.col("lid").alias("number"))
    b = got.select("route_id", F.col("rid").alias("v"), F.col("lid").alias("neighbour"))
    return a.join(adj.select("region_id", "u", "v"), ["region_id", "u"]).join(b, ["route_id", "v"]).where("number <> neighbour").select("route_id", "number", "neighbour").distinct()


def prune_candidates(predicted: DataFrame, region_poles: DataFrame, window: float, k: int = MAX_CANDIDATES) -> DataFrame:
    """Base poles in the box round each prediction (wider with hops), the k nearest: route_id, number, idx, d, rank, unpruned.

    unpruned counts all poles in the box, so that a reader sees where the k nearest are not all of them.

    predicted: route_id, region_id, number, e, n, hops. Rows are classed by box size (powers of two), and each class
    meets the base in cells of its own size.
    """
    half = window * (1 + HOP_GROWTH * F.coalesce("hops", F.lit(0)))
    rows = predicted.withColumn("_w", half).withColumn("_class", F.ceil(F.log2(F.col("_w") / window) - 1e-9).cast("int"))
    classes = rows.select("region_id", "_class").distinct()
    base = region_poles.select("region_id", "idx", F.col("x").alias("_x"), F.col("y").alias("_y")).join(classes, "region_id")
    size = window * F.pow(F.lit(2.0), F.col("_class"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    filed = base.withColumn("_o", F.explode(around)).withColumns({"_cx": F.floor(F.col("_x") / size) + F.col("_o.i"), "_cy": F.floor(F.col("_y") / size) + F.col("_o.j")})
    asked = rows.withColumns({"_cx": F.floor(F.col("e") / size), "_cy": F.floor(F.col("n") / size)})
    met = asked.join(filed.drop("_o"), ["region_id", "_class", "_cx", "_cy"])
    met = met.where((F.abs(F.col("_x") - F.col("e")) <= F.col("_w")) & (F.abs(F.col("_y") - F.col("n")) <= F.col("_w"))).withColumn("d", dist2d("e", "n", "_x", "_y"))
    order = Window.partitionBy("route_id", "number").orderBy("d", "idx")
    met = met.withColumns({"rank": F.row_number().over(order), "unpruned": F.count("*").over(Window.partitionBy("route_id", "number"))})
    return met.where(F.col("rank") <= k).select("route_id", "number", "idx", "d", "rank", "unpruned")


def best_neighbour_by_span(frontier: DataFrame, adj: DataFrame, claimed: DataFrame, tol: float) -> DataFrame:
    """Unclaimed cable neighbour whose span fits the label best: route_id, number, v, delta.

    frontier: route_id, region_id, number, u, label; claimed: route_id, v.
    """
    rows = frontier.join(adj.select("region_id", "u", "v", "w"), ["region_id", "u"]).join(claimed.select("route_id", "v"), ["route_id", "v"], "left_anti")
    fit = rows.withColumn("delta", F.abs(F.col("w") - F.col("label"))).where(F.col("delta") <= tol)
    return (fit.groupBy("route_id", "number").agg(F.min(F.struct("delta", "v")).alias("_b"))
            .select("route_id", "number", "_b.v", "_b.delta"))


# ---------------------------------------------------------------- point thinning

def thin_points(points: DataFrame, radius: float, by=PAGE) -> DataFrame:
    """Keep a point unless an earlier kept one (smaller id) is closer than radius.

    Points on one spot first fall to their smallest id. Then each round keeps every undecided point that has no
    undecided earlier neighbour, and drops the neighbours of the kept.
    """
    from routekit.operators.core import checkpoint
    by = list(by)
    spots = checkpoint(points.groupBy(*by, "x", "y").agg(F.min("point_id").alias("point_id")))
    pairs = checkpoint(radius_pairs(side(spots, "l", "point_id", by=by), side(spots, "r", "point_id", by=by), radius, by)
                       .where((F.col("d") < radius) & (F.col("lid") < F.col("rid"))).select(*by, "lid", "rid"))
    keep = checkpoint(spots.select(*by, F.col("point_id").alias("rid")).join(pairs.select(*by, "rid"), [*by, "rid"], "left_anti"))
    kept, undecided = keep, checkpoint(pairs.select(*by, "rid").distinct())
    while not undecided.isEmpty():
        dropped = pairs.join(keep.select(*by, F.col("rid").alias("lid")), [*by, "lid"], "left_semi").select(*by, "rid").distinct()
        undecided = checkpoint(undecided.join(dropped, [*by, "rid"], "left_anti"))
        blocked = pairs.join(undecided.select(*by, F.col("rid").alias("lid")), [*by, "lid"], "left_semi").select(*by, "rid").distinct()
        keep = checkpoint(undecided.join(blocked, [*by, "rid"], "left_anti"))
        kept = kept.unionByName(keep)
        undecided = checkpoint(undecided.join(keep, [*by, "rid"], "left_anti"))
    return points.join(kept.select(*by, F.col("rid").alias("point_id")), [*by, "point_id"], "left_semi")
