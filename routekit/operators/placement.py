"""Sequence decoding, dead reckoning, page fits, and pole placement along cables and the regional base."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routekit.functions import (INVENTED_SOURCES, destination, dist2d, edge_cost, gps_chord_side, gps_foot_on_chord, gps_lateral_m,
                                gps_reflect, gps_shrink_lateral, chord_side, haversine_m, page_to_gps, page_to_utm, rotate, trilaterate)
from routekit.operators.core import checkpoint, chunked_fold, nearest, number_chunk, ordered_scan, radius_pairs, real, union_all
from routekit.operators.fits import similarity_fit
from routekit.operators.linework import PATH, point_at_arc
from routekit.operators.matching import side
from routekit.operators.sequence import number_runs, worst_adjacent_error

PAGE = ["route_id", "page"]
# Decoding model, seam and corridor limits, repair thresholds.
EMIT_SIGMA_PT, STEP_BETA_M, MIN_ARC_PT = 20.0, 3.0, 4.0
SEAM_LENGTH_M, SEAM_SAMPLES, SEAM_MIN_M, SEAM_MIN_PAIRS, SEAM_SCALE, SEAM_DEG, SEAM_RMSE_GAIN = 20.0, 5, 10.0, 3, 0.02, 12.0, 0.25
CLAMP_M, CLAMP_GAIN_M, MIRROR_MIN_M, SEAM_GAIN_M, SIDE_PT = 8.0, 1.25, 0.75, 0.5, 3.0
BAD_REL, BAD_M, REPAIR_RADIUS_M, REPAIR_MIN_COST, REPAIR_KEEP, MAX_INTERIOR = 0.25, 3.0, 25.0, 2.0, 0.6, 3
SNAP_MARGIN, FALLBACK_HOPS = 1.5, 20


def _labels(spans: DataFrame) -> DataFrame:
    return (spans.where((F.col("meters") > 0) & (F.col("hi") == F.col("lo") + 1)).groupBy("route_id", F.col("hi").alias("number"))
            .agg(F.max("meters").alias("m_in")))


# ---------------------------------------------------------------- dead reckoning

def label_chain(poles: DataFrame, spans: DataFrame, bearings: DataFrame) -> DataFrame:
    """Walk each run by printed metres along given bearings: route_id, number, lat, lon.

    poles carry run (split_runs). A run starts at its own position, or, after a labelled page break, one step from the
    previous pole; a pole without a label re-anchors the walk at its own position. bearings: route_id, number, bearing
    of the step into the pole. The first run keeps its positions.
    """
    rows = poles.join(_labels(spans), ["route_id", "number"], "left").join(bearings, ["route_id", "number"], "left")
    rows = ordered_scan(rows, "route_id", "number", chunk=number_chunk(), lag={"_p": F.struct("lat", "lon", "page")})
    first = F.col("number") == F.col("run")
    broken = first & (F.col("_p.page") != F.col("page")) & (F.col("m_in") > 0) & F.col("bearing").isNotNull()
    start = F.when(broken, destination("_p.lat", "_p.lon", "bearing", "m_in")).otherwise(F.struct("lat", "lon"))
    heads = rows.groupBy("route_id").agg(F.min("run").alias("_r0"))
    ready = rows.join(heads, "route_id").select("route_id", "run", "number", "lat", "lon", "m_in", "bearing", first.alias("first"), start.alias("start"), (F.col("run") == F.col("_r0")).alias("keep"))

    def step(s, r):
        free = r["keep"] | ~F.coalesce((r["m_in"] > 0) & r["bearing"].isNotNull(), F.lit(False))
        here = F.struct(r["lat"].alias("lat"), r["lon"].alias("lon"))
        return F.when(r["first"] & ~r["keep"], r["start"]).when(r["first"] | free, here).otherwise(destination(s["lat"], s["lon"], r["bearing"], r["m_in"]))

    zero = F.struct(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    return chunked_fold(ready, ["route_id", "run"], "number", fields=["lat", "lon", "m_in", "bearing", "first", "start", "keep"], zero=zero, step=step,
                        emit=lambda s, r: F.struct(r["number"].alias("number"), s["lat"].alias("lat"), s["lon"].alias("lon"))).drop("run")


def lock_page_breaks(xf: DataFrame, poles: DataFrame, spans: DataFrame, bearings: DataFrame) -> DataFrame:
    """Shift each page so that its first pole lies one printed step from the page before: adds new origins.

    Pages are taken in order, each from the already shifted one before it. A page break without a label keeps the
    page's own origin. bearings: route_id, number, bearing into the first pole. xf: route_id, page, origin_e, origin_n,
    sx, sy, theta.
    """
    spot = F.struct("number", "x", "y")
    ends = poles.groupBy(*PAGE).agg(F.min_by(spot, "number").alias("f"), F.max_by(spot, "number").alias("l"))
    local = lambda p: page_to_utm(f"{p}.x", f"{p}.y", 0.0, 0.0, "sx", "sy", "theta")
    rows = xf.join(ends, PAGE).withColumns({"fo": local("f"), "lo": local("l"), "number": F.col("f.number")})
    rows = rows.join(_labels(spans), ["route_id", "number"], "left").join(bearings, ["route_id", "number"], "left")

    def step(s, r):
        locked = F.coalesce((r["m_in"] > 0) & s["e"].isNotNull() & r["bearing"].isNotNull(), F.lit(False))
        oe = F.when(locked, s["e"] + r["m_in"] * F.sin(F.radians(r["bearing"])) - r["fo"]["easting"]).otherwise(r["origin_e"])
        on = F.when(locked, s["n"] + r["m_in"] * F.cos(F.radians(r["bearing"])) - r["fo"]["northing"]).otherwise(r["origin_n"])
        return F.struct((oe + r["lo"]["easting"]).alias("e"), (on + r["lo"]["northing"]).alias("n"), oe.alias("oe"), on.alias("on"), locked.alias("locked"))

    null = F.lit(None).cast("double")
    zero = F.struct(null.alias("e"), null.alias("n"), null.alias("oe"), null.alias("on"), F.lit(False).alias("locked"))
    return chunked_fold(rows, "route_id", "page", fields=["origin_e", "origin_n", "fo", "lo", "m_in", "bearing"], zero=zero, step=step,
                        emit=lambda s, r: F.struct(r["page"].alias("page"), s["oe"].alias("origin_e"), s["on"].alias("origin_n"), s["locked"].alias("locked")))


# ---------------------------------------------------------------- decoding

def topk_symbols(poles: DataFrame, symbols: DataFrame, k: int = 4, label_max: float = 100.0, arc_max: float = 60.0, wide: float = 150.0) -> DataFrame:
    """The k best symbols per pole: within label_max of the pole and within arc_max of its expected arc (or its own).

    poles: route_id, page, number, x, y, t, expected_t (nullable); symbols: route_id, page, sym_id, x, y, t. Poles
    without a candidate retry with a window of `wide`. Result: route_id, page, number, sym_id, t, d, rank.
    """
    pairs = radius_pairs(side(poles, "l", "number", extra=[F.col("t").alias("pt"), "expected_t"]), side(symbols, "r", "sym_id", extra=[F.col("t").alias("st")]), label_max, PAGE)
    delta = F.abs(F.col("st") - F.col("pt"))
    off = F.coalesce(F.abs(F.col("st") - F.col("expected_t")), delta)
    scored = pairs.select(*PAGE, F.col("lid").alias("number"), F.col("rid").alias("sym_id"), F.col("st").alias("t"), "d", delta.alias("delta"), off.alias("off"), (off + 0.01 * F.col("d")).alias("score"))
    order = Window.partitionBy(*PAGE, "number").orderBy("score", "sym_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    tight = top(scored.where((F.col("delta") <= arc_max) & (F.col("off") <= arc_max * 1.35)))
    loose = top(scored.where((F.col("delta") <= wide) & (F.col("off") <= wide * 1.35)).join(tight.select(*PAGE, "number").distinct(), [*PAGE, "number"], "left_anti"))
    return tight.unionByName(loose).select(*PAGE, "number", "sym_id", "t", "d", "rank")


def decode_path(candidates: DataFrame, spans: DataFrame, scale: DataFrame, direction: DataFrame) -> DataFrame:
    """Best symbol per pole along each run: emission by distance, transition by arc against label, arc never backward.

    candidates: route_id, page, number, sym_id, t, d (a few per pole). Runs are maximal chains of numbers that have
    candidates. A forward fold keeps the best score and back pointer per candidate, a backward fold reads the path.
    Result: route_id, page, number, sym_id, t; a run that no monotone path crosses gives nothing.
    """
    key = [*PAGE, "run"]
    option = F.struct("sym_id", "t", (-(F.col("d") * F.col("d")) / (2 * EMIT_SIGMA_PT ** 2)).alias("emit"))
    poles = candidates.groupBy(*PAGE, "number").agg(F.array_sort(F.collect_list(option)).alias("opts"))  # k options each
    runs = number_runs(poles).join(_labels(spans), ["route_id", "number"], "left").join(scale.select(*PAGE, "scale"), PAGE).join(direction.select(*PAGE, "direction"), PAGE)
    kind = runs.schema["opts"].dataType.elementType["sym_id"].dataType.simpleString()
    states = f"array<struct<sym_id:{kind},t:double,score:double,back:int>>"

    def forward(s, r):
        def extend(o):
            def arrive(p, i):
                arc = (o["t"] - p["t"]) * r["direction"]
                cost = F.when(r["m_in"] > 0, -F.abs(arc * r["scale"] - r["m_in"]) / STEP_BETA_M).otherwise(0.0)
                return F.when(arc >= MIN_ARC_PT, F.struct((p["score"] + cost).alias("score"), (-i).alias("i")))
            best = F.array_max(F.filter(F.transform(s["st"], arrive), lambda a: a.isNotNull()))
            return F.struct(o["sym_id"].alias("sym_id"), o["t"].alias("t"), (best["score"] + o["emit"]).alias("score"), (-best["i"]).cast("int").alias("back"))
        opening = F.transform(r["opts"], lambda o: F.struct(o["sym_id"].alias("sym_id"), o["t"].alias("t"), o["emit"].alias("score"), F.lit(-1).alias("back")))
        going = F.filter(F.transform(r["opts"], extend), lambda o: o["score"].isNotNull())
        return F.struct(F.when(r["number"] == r["run_no"], opening).otherwise(going).cast(states).alias("st"))

    lattice = chunked_fold(runs.withColumn("run_no", F.col("run")), key, "number", fields=["opts", "m_in", "scale", "direction", "run_no"],
                           zero=F.struct(F.array().cast(states).alias("st")), step=forward,
                           emit=lambda s, r: F.struct(r["number"].alias("number"), s["st"].alias("st")))
    lattice = checkpoint(lattice)
    broken = lattice.where(F.size("st") == 0).select(*key).distinct()
    last = lattice.groupBy(*key).agg(F.max("number").alias("_end"))
    ready = lattice.join(broken, key, "left_anti").join(last, key).withColumn("back_no", -F.col("number")).withColumn("tail", F.col("number") == F.col("_end"))

    def backward(s, r):
        best = F.array_max(F.transform(r["st"], lambda o, i: F.struct(o["score"].alias("score"), (-i).alias("i"))))
        pick = F.when(r["tail"], -best["i"]).otherwise(s["back"]).cast("int")
        chosen = F.try_element_at(r["st"], pick + 1)
        return F.struct(chosen["back"].alias("back"), chosen["sym_id"].alias("sym_id"), chosen["t"].alias("t"))

    zero = F.struct(F.lit(None).cast("int").alias("back"), F.lit(None).cast(kind).alias("sym_id"), F.lit(None).cast("double").alias("t"))
    path = chunked_fold(ready, key, "back_no", fields=["st", "tail"], zero=zero, step=backward,
                        emit=lambda s, r: F.struct((-r["back_no"]).alias("number"), s["sym_id"].alias("sym_id"), s["t"].alias("t")))
    return path.drop("run")


def repair_arc_jumps(poles: DataFrame, symbols: DataFrame, spans: DataFrame, segs: DataFrame, scale: DataFrame, direction: DataFrame,
                     min_m: float = 12.0, ratio: float = 1.6, reach: float = 150.0) -> DataFrame:
    """Re-snap a pole whose arc step misfits its label to the symbol nearest the label-consistent point of the cable.

    poles: route_id, page, path_id, number, x, y, t. All poles are judged against the input positions, in one round.
    Result: route_id, number, sym_id, d of the poles to move.
    """
    back = poles.select(*PATH, (F.col("number") + 1).alias("number"), F.col("t").alias("_tp"))
    rows = (poles.join(back, [*PATH, "number"]).join(_labels(spans), ["route_id", "number"]).join(scale.select(*PAGE, "scale"), PAGE).join(direction.select(*PAGE, "direction"), PAGE))
    arc_m = F.abs(F.col("t") - F.col("_tp")) * F.col("scale")
    bad = (F.abs(arc_m - F.col("m_in")) >= min_m) & ~(arc_m / F.col("m_in")).between(1 / ratio, ratio)
    targets = rows.where(bad).select(*PATH, F.col("number").alias("target_id"), F.greatest(F.lit(0.0), F.col("_tp") + F.col("direction") * F.col("m_in") / F.col("scale")).alias("t"))
    points = point_at_arc(segs, targets)
    hit = nearest(side(points, "l", "target_id", "px", "py"), side(symbols, "r", "sym_id"), PAGE, start=reach / 4, limit=reach)
    return hit.select("route_id", F.col("lid").alias("number"), F.col("rid").alias("sym_id"), "d")


def place_by_arc(poles: DataFrame, spans: DataFrame, segs: DataFrame, hits: DataFrame, scale: DataFrame, direction: DataFrame) -> DataFrame:
    """Put each page's poles on its cable at the arc its labels add up to: route_id, page, number, x, y."""
    from routekit.operators.sequence import expected_arc
    at = expected_arc(poles, spans, hits, scale, direction)
    first = hits.groupBy(*PAGE).agg(F.min_by("path_id", "number").alias("path_id"))
    targets = at.join(first, PAGE).select(*PATH, F.col("number").alias("target_id"), F.greatest(F.lit(0.0), F.col("expected_t")).alias("t"))
    return point_at_arc(segs, targets).select(*PAGE, F.col("target_id").alias("number"), F.col("px").alias("x"), F.col("py").alias("y"))


# ---------------------------------------------------------------- corridor

def mirror_pages(poles: DataFrame, spans: DataFrame) -> DataFrame:
    """Reflect a page whose first pole flipped sides at the page break, where that improves the seam span by 0.5 m.

    poles: route_id, page, number, lat, lon, side (signed cable offset in points). The chord runs from the pole before
    the break's last pole to the one after its first pole, both on their own page. Result: poles with reflected lat, lon.
    """
    spot = F.struct("number", "page", "lat", "lon", "side")
    rows = ordered_scan(poles, "route_id", "number", chunk=number_chunk(), lag={"_p": spot}, lead={"_n": spot})
    before = rows.select("route_id", F.col("number").alias("_pn"), F.col("_p").alias("_a"))
    seams = rows.where(F.col("_p.page") != F.col("page")).withColumn("_pn", F.col("_p.number")).join(before, ["route_id", "_pn"])
    seams = seams.where((F.col("_a.page") == F.col("_p.page")) & (F.col("_n.page") == F.col("page"))).join(_labels(spans), ["route_id", "number"], "left")
    sign = lambda c: F.when(F.col(c) > SIDE_PT, 1).when(F.col(c) < -SIDE_PT, -1).otherwise(0)
    chord = ("_a.lat", "_a.lon", "_n.lat", "_n.lon")
    sp, sc = gps_chord_side("_p.lat", "_p.lon", *chord), gps_chord_side("lat", "lon", *chord)
    image = gps_reflect("lat", "lon", *chord)
    seams = seams.withColumn("_i", image)
    old = F.abs(haversine_m("_p.lat", "_p.lon", "lat", "lon") - F.col("m_in"))
    new = F.abs(haversine_m("_p.lat", "_p.lon", "_i.lat", "_i.lon") - F.col("m_in"))
    flipped = (sign("side") != 0) & (sign("side") == sign("_p.side")) & (sp != 0) & (sc != 0) & (sp != sc) & F.coalesce(new < old - SEAM_GAIN_M, F.lit(True))
    turns = seams.where(flipped).groupBy(*PAGE).agg(F.min_by(F.struct("_a", "_n"), "number").alias("_c"))
    out = poles.join(turns, PAGE, "left").withColumn("_i", gps_reflect("lat", "lon", "_c._a.lat", "_c._a.lon", "_c._n.lat", "_c._n.lon"))
    turn = F.col("_c").isNotNull()
    return out.withColumns({"lat": F.when(turn, F.col("_i.lat")).otherwise(F.col("lat")), "lon": F.when(turn, F.col("_i.lon")).otherwise(F.col("lon")), "mirrored": turn}).drop("_c", "_i")


def _neighbours(poles: DataFrame, columns) -> DataFrame:
    move = lambda shift, p: poles.select(*PAGE, (F.col("number") + shift).alias("number"), *[F.col(c).alias(f"{p}{c}") for c in columns])
    return poles.join(move(1, "p_"), [*PAGE, "number"], "left").join(move(-1, "n_"), [*PAGE, "number"], "left")


def mirror_poles(poles: DataFrame) -> DataFrame:
    """Reflect a pole across its neighbours' chord when its page side and its GPS side differ (lateral at least 0.75 m).

    One round against the input. poles: route_id, page, number, x, y, lat, lon.
    """
    rows = _neighbours(poles, ("x", "y", "lat", "lon"))
    chord = ("p_lat", "p_lon", "n_lat", "n_lon")
    page_side, gps_side = chord_side("x", "y", "p_x", "p_y", "n_x", "n_y"), gps_chord_side("lat", "lon", *chord)
    flip = F.coalesce((page_side != 0) & (gps_side != 0) & (page_side != gps_side) & (gps_lateral_m("lat", "lon", *chord) >= MIRROR_MIN_M), F.lit(False))
    rows = rows.withColumns({"_i": gps_reflect("lat", "lon", *chord), "mirrored": flip})
    pick = lambda c: F.when(F.col("mirrored"), F.col(f"_i.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(*PAGE, "number", "x", "y", pick("lat"), pick("lon"), "mirrored")


def corridor_clamp(poles: DataFrame, corridor: DataFrame, spans: DataFrame, max_m: float = CLAMP_M) -> DataFrame:
    """Pull a pole toward its corridor point until it is at most max_m away; undone where the worst adjacent span grows.

    corridor: route_id, number, c_lat, c_lon, the projected cable foot of poles near the cable. The anchor is the
    farther of that foot and the foot on the neighbours' chord. One round against the input.
    """
    rows = _neighbours(poles, ("lat", "lon")).join(corridor, ["route_id", "number"], "left")
    chord = ("p_lat", "p_lon", "n_lat", "n_lon")
    rows = rows.withColumn("_f", gps_foot_on_chord("lat", "lon", *chord))
    rows = rows.withColumns({"_dc": haversine_m("lat", "lon", "c_lat", "c_lon"), "_df": haversine_m("lat", "lon", "_f.lat", "_f.lon")})
    by_cable = F.coalesce(F.col("_dc") >= F.col("_df"), F.col("_dc").isNotNull())
    rows = rows.withColumns({"_al": F.when(by_cable, F.col("c_lat")).otherwise(F.col("_f.lat")), "_ao": F.when(by_cable, F.col("c_lon")).otherwise(F.col("_f.lon")), "_d": F.greatest("_dc", "_df")})
    moved = rows.where(F.col("_d") > max_m).withColumn("_s", gps_shrink_lateral("lat", "lon", "_al", "_ao", F.lit(max_m)))
    trial = checkpoint(moved.select("route_id", "number", F.col("_s.lat").alias("t_lat"), F.col("_s.lon").alias("t_lon")))
    was = worst_adjacent_error(poles, spans).withColumnRenamed("worst_m", "_was")
    near = lambda shift, p: poles.select("route_id", (F.col("number") + shift).alias("number"), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"))
    out = _labels(spans).select("route_id", (F.col("number") - 1).alias("number"), F.col("m_in").alias("m_out"))
    tried = (trial.join(near(1, "p_"), ["route_id", "number"], "left").join(near(-1, "n_"), ["route_id", "number"], "left")
             .join(_labels(spans), ["route_id", "number"], "left").join(out, ["route_id", "number"], "left").join(was, ["route_id", "number"], "left"))
    now = F.greatest(F.abs(haversine_m("p_lat", "p_lon", "t_lat", "t_lon") - F.col("m_in")), F.abs(haversine_m("t_lat", "t_lon", "n_lat", "n_lon") - F.col("m_out")))
    good = tried.where(~F.coalesce(now > F.col("_was") + CLAMP_GAIN_M, F.lit(False))).select("route_id", "number", "t_lat", "t_lon")
    done = poles.join(good, ["route_id", "number"], "left")
    return done.select("route_id", "number", F.coalesce("t_lat", "lat").alias("lat"), F.coalesce("t_lon", "lon").alias("lon"), F.col("t_lat").isNotNull().alias("clamped"))


# ---------------------------------------------------------------- page fits

def seam_similarity(samples: DataFrame) -> DataFrame:
    """Similarity of each page onto the one before it from cable samples on both sides of the seam, with its verdict.

    samples: route_id, page, side_m, px, py, qx, qy (point of this page, matching point continued from the page before).
    Kept with three pairs over ten metres, under 12 degrees; scale beyond 2 % is forced to 1. RMSE before and after.
    """
    fit = similarity_fit(samples, PAGE)
    reach = samples.groupBy(*PAGE).agg((F.max("side_m") - F.min("side_m")).alias("reach_m"))
    centre = samples.groupBy(*PAGE).agg(*[F.avg(c).alias(f"m{c}") for c in ("px", "py", "qx", "qy")])
    forced = F.when(F.abs(F.col("scale") - 1) > SEAM_SCALE, 1.0).otherwise(F.col("scale"))
    rows = fit.drop("tx", "ty").join(reach, PAGE).join(centre, PAGE).withColumn("scale", forced)
    turned = rotate("mpx", "mpy", F.col("theta"))
    rows = rows.withColumn("_r", turned).withColumns({"tx": F.col("mqx") - F.col("scale") * F.col("_r.x"), "ty": F.col("mqy") - F.col("scale") * F.col("_r.y")})
    checked = samples.join(rows.select(*PAGE, "scale", "theta", "tx", "ty"), PAGE).withColumn("_r", rotate("px", "py", F.col("theta")))
    err = dist2d(F.col("scale") * F.col("_r.x") + F.col("tx"), F.col("scale") * F.col("_r.y") + F.col("ty"), "qx", "qy")
    rmse = checked.groupBy(*PAGE).agg(F.sqrt(F.avg(F.pow(dist2d("px", "py", "qx", "qy"), F.lit(2.0)))).alias("rmse_before"), F.sqrt(F.avg(F.pow(err, F.lit(2.0)))).alias("rmse_after"))
    ok = ((F.col("n") >= SEAM_MIN_PAIRS) & (F.col("reach_m") >= SEAM_MIN_M) & (F.abs(F.degrees("theta")) <= SEAM_DEG) & (F.col("rmse_after") <= F.col("rmse_before") + SEAM_RMSE_GAIN))
    return rows.join(rmse, PAGE).select(*PAGE, "n", "scale", "theta", "tx", "ty", "rmse_before", "rmse_after", ok.alias("accepted"))


_STEP = T.StructType([T.StructField("route_id", T.LongType()), T.StructField("page", T.IntegerType()),
                      *[T.StructField(c, T.DoubleType()) for c in ("de", "dn", "dt")]])


def _solve(batches):
    """Damped normal equations of many routes: rows (route_id, pages, h, g, lam) to per-page steps."""
    import numpy as np
    import pandas as pd
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            at = {p: i for i, p in enumerate(row.pages)}
            k = 3 * len(at)
            h, g = np.zeros((k, k)), np.zeros(k)
            for e in row.h:
                i, j = at[e["pi"]] * 3 + e["vi"], at[e["pj"]] * 3 + e["vj"]
                h[i, j] += e["s"]
            for e in row.g:
                g[at[e["pi"]] * 3 + e["vi"]] += e["s"]
            try:
                step = np.linalg.solve(h + row.lam * np.diag(np.maximum(np.diag(h), 1e-9)), -g)
            except np.linalg.LinAlgError:
                step = np.zeros(k)
            out += [(row.route_id, p, step[3 * i], step[3 * i + 1], step[3 * i + 2]) for p, i in at.items()]
        yield pd.DataFrame(out, columns=["route_id", "page", "de", "dn", "dt"])


_FIT = T.StructType([*_STEP.fields[:2], *[T.StructField(c, T.DoubleType()) for c in ("origin_e", "origin_n", "theta", "rmse0", "rmse")]])
_OBS = ("ap", "bp", "ax", "ay", "as", "bx", "by", "bs", "meters")
_PAGES = ("page", "origin_e", "origin_n", "theta", "wt")
SMALL_OBS, SMALL_PAGES, AT_ONCE = 256, 16, 1000


def _fit_batch(batch, rounds: int, damping: float):
    """The rounds of fit_page_origins for the routes of one Arrow batch (lists of _OBS and _PAGES a row), all in step."""
    import numpy as np
    import pyarrow as pa
    col = lambda c: batch.column(batch.schema.names.index(c)).flatten().to_numpy(zero_copy_only=False)
    lengths = lambda c: batch.column(batch.schema.names.index(c)).value_lengths().to_numpy(zero_copy_only=False)
    routes = batch.num_rows
    of_obs, of_page = np.repeat(np.arange(routes), lengths("ap")), np.repeat(np.arange(routes), lengths("page"))
    ap, bp, ax, ay, a_s, bx, by, b_s, meters = (col(c) for c in _OBS)
    page, oe, on, th, wt = (col(c) for c in _PAGES)
    known = np.unique(page)
    key = lambda route, p: route * len(known) + np.searchsorted(known, p)
    a, b = (np.searchsorted(key(of_page, page), key(of_obs, p)) for p in (ap, bp))  # pages come in order
    th0, free = th.copy(), ~np.isnan(wt)
    before = np.cumsum(free) - free
    first = np.concatenate([[0], np.cumsum(lengths("page"))[:-1]])
    place = before - before[first][of_page]  # of a free page among those of its route
    size = 3 * int((place + 1)[free].max(initial=0))
    de, dn, dt = np.zeros(len(page)), np.zeros(len(page)), np.zeros(len(page))
    lam, rmse, rmse0, done = np.full(routes, damping), np.full(routes, np.nan), np.full(routes, np.nan), np.zeros(routes, bool)
    for _ in range(rounds):
        te, tn, tt = oe + de, on + dn, th + dt
        at = np.flatnonzero(~done[of_obs])
        i, j, route = a[at], b[at], of_obs[at]

        def end(k, x, y, scale):
            c, d = scale * (np.cos(tt[k]) * x + np.sin(tt[k]) * y), scale * (np.cos(tt[k]) * y - np.sin(tt[k]) * x)
            return te[k] + c, tn[k] - d, d, scale * (np.sin(tt[k]) * y + np.cos(tt[k]) * x)

        ea, na, kea, kna = end(i, ax[at], ay[at], a_s[at])
        eb, nb, keb, knb = end(j, bx[at], by[at], b_s[at])
        dx, dy = eb - ea, nb - na
        length = np.maximum(np.sqrt(dx * dx + dy * dy), 1e-9)
        r, ux, uy = length - meters[at], dx / length, dy / length
        count = np.bincount(route, minlength=routes)
        now = np.sqrt(np.bincount(route, r * r, routes) / np.maximum(count, 1))
        start = np.isnan(rmse)
        better = ~done & (start | (now < rmse))
        least = np.where(start, now, np.minimum(rmse, now))
        stop = done | (least < 0.5) | (better & ~start & (rmse - now < 1e-3)) | (lam > 1e6)
        lam = np.where(start, lam, np.where(better, lam / 2, lam * 5))
        rmse, rmse0 = np.where(done, rmse, least), np.where(np.isnan(rmse0), now, rmse0)
        took = better[of_page]
        oe, on, th = np.where(took, te, oe), np.where(took, tn, on), np.where(took, tt, th)
        kept, again = better & ~stop, (~better & ~stop)[of_page]
        done = stop
        if done.all():
            break
        number = np.cumsum(kept) - kept  # of a route among those that are solved
        m = int(kept.sum())
        h, g = np.zeros(m * size * size), np.zeros(m * size)
        mine = kept[route]
        entries = [(k[mine], v, c[mine]) for k, sign, ke, kn in ((i, -1, kea, kna), (j, 1, keb, knb)) for v, c in enumerate((sign * ux, sign * uy, sign * (ux * ke + uy * kn)))]
        base = number[route[mine]] * size
        for k, v, c in entries:
            row, use = base + 3 * place[k] + v, free[k]
            g += np.bincount(row[use], (c * r[mine])[use], m * size)
            for l, w, d in entries:
                both = use & free[l]
                h += np.bincount((row * size + 3 * place[l] + w)[both], (c * d)[both], m * size * size)
        p = np.flatnonzero(free & kept[of_page])
        row = number[of_page[p]] * size + 3 * place[p] + 2
        g[row] += wt[p] * (th[p] - th0[p])
        h[row * size + 3 * place[p] + 2] += wt[p]
        h, g = h.reshape(m, size, size), g.reshape(m, size)
        diagonal = np.einsum("kii->ki", h)
        diagonal += lam[kept][:, None] * np.maximum(diagonal, 1e-9)
        used = np.bincount(of_page[free], minlength=routes)[kept] * 3
        diagonal[np.arange(size) >= used[:, None]] = 1  # places that a route has no page for
        step = np.zeros((m, size))
        try:
            step = np.linalg.solve(h, -g[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            for k in range(m):
                try:
                    step[k] = np.linalg.solve(h[k], -g[k])
                except np.linalg.LinAlgError:
                    pass
        # a rejected step is retried at a fifth
        de, dn, dt = (np.where(again, d / 5, 0.0) for d in (de, dn, dt))
        for v, d in enumerate((de, dn, dt)):
            d[p] = step[number[of_page[p]], 3 * place[p] + v]
    route_id = batch.column(0).take(pa.array(of_page))
    return pa.RecordBatch.from_arrays([route_id, pa.array(page, pa.int32()), *(pa.array(x, pa.float64()) for x in (oe, on, th, rmse0[of_page], rmse[of_page]))], _FIT.names)


def _fit_small(obs: DataFrame, pages: DataFrame, rounds: int, damping: float) -> DataFrame:
    """fit_page_origins for routes of few spans and pages whose figures are all given: each route is one row, fitted in one go."""
    listed = lambda df, names, order: df.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct(*order, *(F.col(c).alias(f"_{c}") for c in names)))).alias("_l")).select(
        "route_id", *(F.transform("_l", lambda x: x[f"_{c}"]).alias(c) for c in names))
    rows = listed(obs, _OBS, ["lo", "hi"]).join(listed(pages, _PAGES, ["page"]), "route_id")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                yield _fit_batch(batch.slice(at, AT_ONCE), rounds, damping)

    return rows.mapInArrow(run, _FIT)


def _small_routes(obs: DataFrame, pages: DataFrame) -> DataFrame:
    given = lambda *names: F.min(F.when(real(*names), 1).otherwise(0))
    few = obs.groupBy("route_id").agg(F.count("*").alias("_n"), given("ax", "ay", "as", "bx", "by", "bs", "meters").alias("_g")).where((F.col("_n") <= SMALL_OBS) & (F.col("_g") == 1))
    part = pages.groupBy("route_id").agg(F.count("*").alias("_p"), F.count_distinct("page").alias("_q"), given("origin_e", "origin_n", "theta").alias("_h")).where((F.col("_p") <= SMALL_PAGES) & (F.col("_p") == F.col("_q")) & (F.col("_h") == 1))
    return few.join(part, "route_id").select("route_id")


def fit_page_origins(xf: DataFrame, poles: DataFrame, spans: DataFrame, anchor_pages: DataFrame, rounds: int = 50, damping: float = 1e-3) -> DataFrame:
    """Least squares for the origin and rotation of every page but the anchor's, so that span lengths meet their labels.

    Damped steps for all routes at once: residual and Jacobian columns, sums of products per route, one small solve per
    route (three unknowns per page). A step is kept where the route's RMSE drops; damping halves then, else grows
    fivefold. A weak prior holds the rotation (weight 10 with under two page-crossing labels, else 0.01). A route stops
    under 0.5 m or once a kept step gains under 0.001 m. Result: route_id, page, origin_e, origin_n, theta, rmse0, rmse.
    Routes of few spans and pages are fitted in one go; the others, and those with figures missing, go through written rounds.
    """
    at = lambda s, n: poles.select("route_id", F.col("number").alias(n), F.col("page").alias(f"{s}p"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    scales = lambda s: xf.select("route_id", F.col("page").alias(f"{s}p"), F.col("sx").alias(f"{s}s"))
    obs = (spans.where((F.col("meters") > 0) & (F.col("hi") == F.col("lo") + 1)).select("route_id", "lo", "hi", "meters")
           .join(at("a", "lo"), ["route_id", "lo"]).join(at("b", "hi"), ["route_id", "hi"]).join(scales("a"), ["route_id", "ap"]).join(scales("b"), ["route_id", "bp"]))
    enough = obs.groupBy("route_id").agg(F.count("*").alias("_n")).where("_n >= 3").select("route_id")
    obs = checkpoint(obs.join(enough, "route_id", "left_semi"))
    free = xf.select(*PAGE).join(anchor_pages.select(*PAGE), PAGE, "left_anti")
    crossing = obs.where("ap <> bp").select("route_id", F.explode(F.array("ap", "bp")).alias("page")).groupBy(*PAGE).agg(F.count("*").alias("_c"))
    prior = free.join(crossing, PAGE, "left").select(*PAGE, F.when(F.coalesce("_c", F.lit(0)) < 2, 10.0).otherwise(0.01).alias("wt"))
    pages = checkpoint(xf.join(enough, "route_id", "left_semi").join(prior, PAGE, "left")
                       .select(*PAGE, "origin_e", "origin_n", "theta", F.col("theta").alias("theta0"), "wt", F.lit(0.0).alias("de"), F.lit(0.0).alias("dn"), F.lit(0.0).alias("dt")))
    small = checkpoint(_small_routes(obs, pages))
    fitted = _fit_small(obs.join(small, "route_id", "left_semi"), pages.join(small, "route_id", "left_semi"), rounds, damping)
    enough = checkpoint(enough.join(small, "route_id", "left_anti"))
    if enough.isEmpty():
        return fitted
    obs, pages = (checkpoint(df.join(enough, "route_id", "left_semi")) for df in (obs, pages))
    route = checkpoint(enough.select("route_id", F.lit(damping).alias("lam"), F.lit(None).cast("double").alias("rmse"), F.lit(None).cast("double").alias("rmse0"), F.lit(False).alias("done")))
    for _ in range(rounds):
        tried = pages.withColumns({"te": F.col("origin_e") + F.col("de"), "tn": F.col("origin_n") + F.col("dn"), "tt": F.col("theta") + F.col("dt")})
        live = route.where("NOT done").select("route_id")
        par = lambda s: tried.select("route_id", F.col("page").alias(f"{s}p"), *[F.col(c).alias(f"{s}{c}") for c in ("te", "tn", "tt")], F.col("wt").isNotNull().alias(f"{s}free"))
        rows = obs.join(live, "route_id", "left_semi").join(par("a"), ["route_id", "ap"]).join(par("b"), ["route_id", "bp"])
        e = lambda s: F.col(f"{s}te") + F.col(f"{s}s") * (F.cos(f"{s}tt") * F.col(f"{s}x") + F.sin(f"{s}tt") * F.col(f"{s}y"))
        n = lambda s: F.col(f"{s}tn") - F.col(f"{s}s") * (F.cos(f"{s}tt") * F.col(f"{s}y") - F.sin(f"{s}tt") * F.col(f"{s}x"))
        ke = lambda s: F.col(f"{s}s") * (F.cos(f"{s}tt") * F.col(f"{s}y") - F.sin(f"{s}tt") * F.col(f"{s}x"))
        kn = lambda s: F.col(f"{s}s") * (F.sin(f"{s}tt") * F.col(f"{s}y") + F.cos(f"{s}tt") * F.col(f"{s}x"))
        rows = rows.withColumns({"dx": e("b") - e("a"), "dy": n("b") - n("a")}).withColumn("len", F.greatest(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.lit(1e-9)))
        rows = rows.withColumns({"r": F.col("len") - F.col("meters"), "ux": F.col("dx") / F.col("len"), "uy": F.col("dy") / F.col("len")})
        grad = lambda s, sg: [sg * F.col("ux"), sg * F.col("uy"), sg * (F.col("ux") * ke(s) + F.col("uy") * kn(s))]
        entry = lambda s, sg: [F.when(F.col(f"{s}free"), F.struct(F.col(f"{s}p").alias("p"), F.lit(i).alias("v"), c.alias("j"))) for i, c in enumerate(grad(s, sg))]
        jac = checkpoint(rows.select("route_id", "lo", "r", F.array_compact(F.array(*entry("a", -1), *entry("b", 1))).alias("j")))
        score = jac.groupBy("route_id").agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("now"))
        judged = route.join(score, "route_id", "left")
        better = F.col("rmse").isNull() | (F.col("now") < F.col("rmse"))
        gain = F.col("rmse") - F.col("now")
        judged = checkpoint(judged.select(
            "route_id", "done", (better & ~F.col("done")).alias("took"),
            F.when(F.col("rmse").isNull(), F.col("lam")).when(better, F.col("lam") / 2).otherwise(F.col("lam") * 5).alias("lam"),
            F.when(F.col("done"), F.col("rmse")).otherwise(F.least("rmse", "now")).alias("rmse"), F.coalesce("rmse0", "now").alias("rmse0"),
            (F.col("done") | (F.least("rmse", "now") < 0.5) | (better & F.coalesce(gain < 1e-3, F.lit(False))) | (F.col("lam") > 1e6)).alias("stop")))
        took = judged.select("route_id", "took")
        moved = tried.join(took, "route_id").withColumns({"origin_e": F.when(F.col("took"), F.col("te")).otherwise(F.col("origin_e")), "origin_n": F.when(F.col("took"), F.col("tn")).otherwise(F.col("origin_n")),
                                                          "theta": F.when(F.col("took"), F.col("tt")).otherwise(F.col("theta"))}).select(*PAGE, "origin_e", "origin_n", "theta", "theta0", "wt")
        moved = checkpoint(moved)
        route = judged.select("route_id", "lam", "rmse", "rmse0", F.col("stop").alias("done"))
        open_routes = route.where("NOT done")
        if open_routes.isEmpty():
            pages = moved
            break
        # sums for routes whose last step was kept are at the new point; rejected ones re-use the same point's sums only
        # through a smaller step, so their products are taken again from the kept parameters in the next round
        kept = judged.where("took AND NOT stop").select("route_id")
        flat = jac.join(kept, "route_id", "left_semi").select("route_id", "lo", "r", F.explode("j").alias("a"), "j")
        hess = flat.select("route_id", "a", F.explode("j").alias("b")).groupBy("route_id", F.col("a.p").alias("pi"), F.col("a.v").alias("vi"), F.col("b.p").alias("pj"), F.col("b.v").alias("vj")).agg(F.sum(F.col("a.j") * F.col("b.j")).alias("s"))
        pull = moved.where("wt IS NOT NULL").select("route_id", F.col("page").alias("pi"), F.lit(2).alias("vi"), "wt", (F.col("wt") * (F.col("theta") - F.col("theta0"))).alias("gs"))
        hess = hess.unionByName(pull.join(kept, "route_id", "left_semi").select("route_id", "pi", "vi", F.col("pi").alias("pj"), F.col("vi").alias("vj"), F.col("wt").alias("s")))
        grads = flat.groupBy("route_id", F.col("a.p").alias("pi"), F.col("a.v").alias("vi")).agg(F.sum(F.col("a.j") * F.col("r")).alias("s"))
        grads = grads.unionByName(pull.join(kept, "route_id", "left_semi").select("route_id", "pi", "vi", F.col("gs").alias("s")))
        system = (hess.groupBy("route_id").agg(F.collect_list(F.struct("pi", "vi", "pj", "vj", "s")).alias("h"))
                  .join(grads.groupBy("route_id").agg(F.collect_list(F.struct("pi", "vi", "s")).alias("g"), F.array_sort(F.collect_set("pi")).alias("pages")), "route_id")
                  .join(route.select("route_id", "lam"), "route_id"))
        steps = system.select("route_id", "pages", "h", "g", "lam").mapInPandas(_solve, _STEP)
        # a rejected step is retried at a fifth: with the damping raised, the direction is kept and shortened
        old = tried.join(judged.where("NOT took AND NOT stop").select("route_id"), "route_id", "left_semi").select(*PAGE, (F.col("de") / 5).alias("de"), (F.col("dn") / 5).alias("dn"), (F.col("dt") / 5).alias("dt"))
        step = steps.unionByName(old)
        pages = checkpoint(moved.join(step, PAGE, "left").fillna({"de": 0.0, "dn": 0.0, "dt": 0.0}))
    rest = pages.join(route.select("route_id", "rmse0", "rmse"), "route_id").select(*PAGE, "origin_e", "origin_n", "theta", "rmse0", "rmse")
    return fitted.unionByName(rest)


# ---------------------------------------------------------------- propagation on the base

def propagate_positions(conns: DataFrame, anchors: DataFrame, poles: DataFrame, base: DataFrame | None = None, median_span: float = 30.0, snap_r: float = 10.0) -> DataFrame:
    """Predicted positions from the anchor along the least uncertain chain: route_id, number, e, n, hops.

    conns: route_id, u, v, meters, source; poles: route_id, number, e, n (drawn positions, for direction and for
    unlabelled lengths); anchors: route_id, number, e, n. A trusted label costs 1, any other hop 1 + length/median. The
    cheapest tree is built first (frontier relaxation), then positions go down it level by level; with base
    (route_id, idx, x, y) a position locks onto a base pole that is clearly nearest. Poles no chain reaches keep their
    drawn position with 20 hops.
    """
    from routekit.operators.graph import both_ways
    drawn = poles.select("route_id", "number", "e", "n")
    at = lambda s: drawn.select("route_id", F.col("number").alias(s), F.col("e").alias(f"{s}e"), F.col("n").alias(f"{s}n"))
    trusted = (F.col("meters") > 0) & ~F.coalesce(F.col("source").isin(INVENTED_SOURCES), F.lit(False))
    links = both_ways(conns.withColumn("m", F.when(trusted, F.col("meters"))), ["route_id"], ["m"]).groupBy("route_id", "u", "v").agg(F.max("m").alias("m"))
    links = links.join(at("u"), ["route_id", "u"]).join(at("v"), ["route_id", "v"]).withColumn("gap", dist2d("ue", "un", "ve", "vn"))
    length = F.coalesce("m", "gap")
    links = checkpoint(links.select("route_id", "u", "v", length.alias("d"), F.when(F.col("m").isNotNull(), 1.0).otherwise(1 + F.col("gap") / median_span).alias("cost"),
                                    ((F.col("ve") - F.col("ue")) / F.nullif("gap", F.lit(0.0))).alias("dx"), ((F.col("vn") - F.col("un")) / F.nullif("gap", F.lit(0.0))).alias("dy")))
    best = checkpoint(anchors.select("route_id", F.col("number").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("int").alias("parent")))
    frontier = best
    while True:
        reach = links.withColumnRenamed("cost", "_c").join(frontier.select("route_id", F.col("node").alias("u"), "cost"), ["route_id", "u"])
        offer = reach.groupBy("route_id", F.col("v").alias("node")).agg(F.min(F.struct((F.col("cost") + F.col("_c")).alias("cost"), F.col("u").alias("parent"))).alias("_o"))
        nearer = offer.join(best.select("route_id", "node", F.col("cost").alias("_was")), ["route_id", "node"], "left").where(F.col("_was").isNull() | (F.col("_o.cost") < F.col("_was")))
        frontier = checkpoint(nearer.select("route_id", "node", F.col("_o.cost").alias("cost"), F.col("_o.parent").cast("int").alias("parent")))
        if frontier.isEmpty():
            break
        best = checkpoint(best.join(frontier.select("route_id", "node"), ["route_id", "node"], "left_anti").unionByName(frontier))
    steps = checkpoint(best.where("parent IS NOT NULL").join(links.select("route_id", F.col("u").alias("parent"), F.col("v").alias("node"), "d", "dx", "dy"), ["route_id", "parent", "node"]))
    level = checkpoint(anchors.select("route_id", F.col("number").alias("node"), "e", "n"))
    out = [level]
    while True:
        moved = steps.join(level.select("route_id", F.col("node").alias("parent"), F.col("e").alias("pe"), F.col("n").alias("pn")), ["route_id", "parent"])
        moved = moved.select("route_id", "node", (F.col("pe") + F.coalesce("dx", F.lit(1.0)) * F.col("d")).alias("e"), (F.col("pn") + F.coalesce("dy", F.lit(0.0)) * F.col("d")).alias("n"))
        if base is not None:
            pairs = radius_pairs(side(moved, "l", "node", "e", "n", by=["route_id"]), side(base, "r", "idx", by=["route_id"]), snap_r * SNAP_MARGIN, ["route_id"])
            two = pairs.groupBy("route_id", F.col("lid").alias("node")).agg(F.min(F.struct("d", "rx", "ry")).alias("_b"), F.slice(F.array_sort(F.collect_list("d")), 2, 1).alias("_s"))
            clear = (F.col("_b.d") <= snap_r) & F.coalesce(F.try_element_at("_s", F.lit(1)) >= F.col("_b.d") * SNAP_MARGIN, F.lit(True))
            moved = moved.join(two.where(clear).select("route_id", "node", "_b.rx", "_b.ry"), ["route_id", "node"], "left").select("route_id", "node", F.coalesce("rx", "e").alias("e"), F.coalesce("ry", "n").alias("n"))
        level = checkpoint(moved)
        if level.isEmpty():
            break
        out.append(level)
    placed = union_all(out).join(best.select("route_id", "node", F.ceil("cost").cast("int").alias("hops")), ["route_id", "node"]).select("route_id", F.col("node").alias("number"), "e", "n", "hops")
    rest = drawn.join(placed.select("route_id", "number"), ["route_id", "number"], "left_anti").withColumn("hops", F.lit(FALLBACK_HOPS))
    return placed.unionByName(rest)


def propose_repairs(poles: DataFrame, spans: DataFrame, base: DataFrame, virtual: DataFrame) -> DataFrame:
    """New positions for short stretches whose trusted spans misfit: route_id, number, e, n, virtual, cost_before, cost_after.

    A window is a run of one or two neighbouring bad edges (over 25 % and 3 m off) with at most three poles inside and
    clean poles outside. Candidates are the base poles within 25 m (at most ten, the nearest) and one virtual position
    (circles round the outer poles near the estimate in `virtual`: route_id, number, x, y); two neighbouring virtual poles
    are not allowed. The cheapest combination replaces the window when it costs under 60 % of the old one.
    """
    good = _labels(spans)
    trusted = spans.where((F.col("meters") > 0) & (F.col("hi") == F.col("lo") + 1)).select("route_id", F.col("hi").alias("number"), "meters", F.coalesce(F.col("source").isin(INVENTED_SOURCES), F.lit(False)).alias("inv"))
    prev = poles.select("route_id", (F.col("number") + 1).alias("number"), F.col("page").alias("pp"), F.col("e").alias("pe"), F.col("n").alias("pn"))
    edges = poles.join(prev, ["route_id", "number"]).join(trusted, ["route_id", "number"], "left").withColumn("span", dist2d("pe", "pn", "e", "n"))
    off = F.abs(F.col("span") - F.col("meters"))
    edges = edges.withColumn("bad", F.coalesce(~F.col("inv") & (off > BAD_REL * F.col("meters")) & (off > BAD_M) & (F.col("pp") == F.col("page")), F.lit(False)))
    bad = edges.where("bad").select("route_id", "number", "page")
    runs = checkpoint(number_runs(bad).groupBy("route_id", "page", "run").agg(F.min("number").alias("a"), F.max("number").alias("b")))
    windows = runs.withColumns({"lo": F.col("a") - 1, "hi": F.when(F.col("a") == F.col("b"), F.col("b") + 1).otherwise(F.col("b"))}).where((F.col("hi") - F.col("lo") - 1).between(1, MAX_INTERIOR))
    inner = windows.select("route_id", "run", "lo", "hi", F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1)).alias("number"))
    here = poles.select("route_id", "number", "e", "n")
    inner = checkpoint(inner.join(here, ["route_id", "number"]))
    near = radius_pairs(inner.select("route_id", F.struct("run", "number").alias("lid"), F.col("e").alias("lx"), F.col("n").alias("ly")), base.select("route_id", F.col("idx").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry")), REPAIR_RADIUS_M, ["route_id"])
    rank = F.row_number().over(Window.partitionBy("route_id", "lid").orderBy("d", "rid"))
    real = near.withColumn("k", rank).where("k <= 10").select("route_id", "lid.run", "lid.number", F.col("rx").alias("ce"), F.col("ry").alias("cn"), F.lit(False).alias("virt"))
    ends = lambda s: here.select("route_id", F.col("number").alias(s), F.col("e").alias(f"{s}e"), F.col("n").alias(f"{s}n"))
    around = inner.join(virtual.select("route_id", "number", "x", "y"), ["route_id", "number"]).join(ends("lo"), ["route_id", "lo"]).join(ends("hi"), ["route_id", "hi"])
    around = around.join(good, ["route_id", "number"]).join(good.select("route_id", (F.col("number") - 1).alias("number"), F.col("m_in").alias("m_out")), ["route_id", "number"])
    ghost = around.where("hi = lo + 2").withColumn("_t", trilaterate("loe", "lon", "m_in", "hie", "hin", "m_out", "x", "y")).select("route_id", "run", "number", F.col("_t.x").alias("ce"), F.col("_t.y").alias("cn"), F.lit(True).alias("virt"))
    options = real.unionByName(ghost).groupBy("route_id", "run", "number").agg(F.array_sort(F.collect_list(F.struct("ce", "cn", "virt"))).alias("opts"))  # eleven at most
    label = edges.select("route_id", "number", "meters", "inv", "span")
    cost = lambda span, row: edge_cost(span, F.col(f"{row}.meters"), F.col(f"{row}.inv"))
    rows = windows.select("route_id", "run", "lo", "hi").join(ends("lo"), ["route_id", "lo"]).join(ends("hi"), ["route_id", "hi"])
    before = windows.join(label, "route_id").where("number > lo AND number <= hi").groupBy("route_id", "run").agg(F.sum(edge_cost("span", "meters", "inv")).alias("cost_before"))
    combos = rows.select("route_id", "run", "lo", "hi", "hie", "hin", F.array(F.struct(F.col("loe").alias("ce"), F.col("lon").alias("cn"), F.lit(False).alias("virt"))).alias("path"), F.lit(0.0).alias("cost"))
    finished = []
    for depth in range(1, MAX_INTERIOR + 2):
        at = combos.withColumn("number", F.col("lo") + depth)
        closing = at.where("number = hi").join(label, ["route_id", "number"])
        last = F.element_at("path", -1)
        finished.append(closing.select("route_id", "run", "lo", F.slice("path", 2, 10).alias("path"), (F.col("cost") + edge_cost(dist2d(last["ce"], last["cn"], "hie", "hin"), "meters", "inv")).alias("cost")))
        step = at.where("number < hi").join(options, ["route_id", "run", "number"]).join(label, ["route_id", "number"]).withColumn("o", F.explode("opts"))
        step = step.where(~(F.col("o.virt") & F.element_at("path", -1)["virt"]))
        combos = step.select("route_id", "run", "lo", "hi", "hie", "hin", F.concat("path", F.array("o")).alias("path"),
                             (F.col("cost") + edge_cost(dist2d(F.element_at("path", -1)["ce"], F.element_at("path", -1)["cn"], "o.ce", "o.cn"), "meters", "inv")).alias("cost"))
    best = union_all(finished).groupBy("route_id", "run", "lo").agg(F.min(F.struct("cost", "path")).alias("_b"))
    chosen = best.join(before, ["route_id", "run"]).where((F.col("cost_before") >= REPAIR_MIN_COST) & (F.col("_b.cost") < REPAIR_KEEP * F.col("cost_before")))
    return chosen.select("route_id", "lo", "cost_before", F.col("_b.cost").alias("cost_after"), F.posexplode("_b.path").alias("i", "p")).select(
        "route_id", (F.col("lo") + 1 + F.col("i")).alias("number"), F.col("p.ce").alias("e"), F.col("p.cn").alias("n"), F.col("p.virt").alias("virtual"), "cost_before", "cost_after")
