"""Closed-form fits by sums per key, and page transforms."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routekit.functions import dist2d, page_to_utm, rotate, utm_forward
from routekit.operators.core import number_chunk, ordered_scan, true_median

PAGE = ["route_id", "page"]
# Fit limits.
MIN_CONTROLS, MAX_CONTROL_ERROR_M = 4, 2.0
NOISE = 1e-12  # of a moment's scale: rounding of sums
CHORD_MIN_PT, SCALE_MIN_SAMPLES = 5.0, 3
REFIT_MAX_DEG, REFIT_MAX_SCALE, REFIT_MAX_RMSE_GAIN = 6.0, 0.06, 0.5


def _pole_ends(poles: DataFrame, spans: DataFrame, columns) -> DataFrame:
    """Spans with the named columns of both poles as a_<c>, b_<c>."""
    end = lambda s, n: poles.select("route_id", F.col("number").alias(n), *[F.col(c).alias(f"{s}_{c}") for c in columns])
    return spans.join(end("a", "lo"), ["route_id", "lo"]).join(end("b", "hi"), ["route_id", "hi"])


def label_scale(poles: DataFrame, spans: DataFrame) -> DataFrame:
    """Metres per point of a route: printed metres over drawn points on same-page labelled spans."""
    rows = _pole_ends(poles, spans.where(F.col("meters") > 0), ["page", "x", "y"]).where("a_page = b_page")
    drawn = dist2d("a_x", "a_y", "b_x", "b_y")
    sums = rows.groupBy("route_id").agg(F.sum("meters").alias("_m"), F.sum(drawn).alias("_p"))
    return sums.select("route_id", F.when(F.col("_p") > 0, F.col("_m") / F.col("_p")).alias("scale"))


def drawn_scale(poles: DataFrame, spans: DataFrame) -> DataFrame:
    """Median metres per point per page; pages with few samples take the route median (both need three)."""
    rows = _pole_ends(poles, spans.where((F.col("meters") > 0) & (F.col("hi") == F.col("lo") + 1)), ["page", "x", "y"]).where("a_page = b_page")
    rows = rows.withColumn("_pt", dist2d("a_x", "a_y", "b_x", "b_y")).where(F.col("_pt") > CHORD_MIN_PT)
    rows = rows.select("route_id", F.col("a_page").alias("page"), (F.col("meters") / F.col("_pt")).alias("_s"))
    paged = true_median(rows, PAGE, "_s", "_ms", width=0.25).where(F.col("n") >= SCALE_MIN_SAMPLES).drop("n")
    whole = true_median(rows, "route_id", "_s", "_mr", width=0.25).where(F.col("n") >= SCALE_MIN_SAMPLES).drop("n")
    return (poles.select(*PAGE).distinct().join(whole, "route_id").join(paged, PAGE, "left")
            .select(*PAGE, F.coalesce("_ms", "_mr").alias("scale")))


def affine_fit(controls: DataFrame, by=("route_id", "page")) -> DataFrame:
    """Least-squares 2×2 map from (x, -y) to (e_rel, n_rel), from seven sums per key; four controls at least."""
    p = -F.col("y")
    sums = controls.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * p).alias("xp"), F.sum(p * p).alias("pp"),
        F.sum(F.col("x") * F.col("e_rel")).alias("xe"), F.sum(p * F.col("e_rel")).alias("pe"),
        F.sum(F.col("x") * F.col("n_rel")).alias("xn"), F.sum(p * F.col("n_rel")).alias("pn"))
    det = F.col("xx") * F.col("pp") - F.col("xp") * F.col("xp")
    solve = lambda a, b: (F.col(a) * F.col("pp") - F.col(b) * F.col("xp")) / F.col("_d")
    solve2 = lambda a, b: (F.col(b) * F.col("xx") - F.col(a) * F.col("xp")) / F.col("_d")
    return (sums.withColumn("_d", det).where((F.col("n") >= MIN_CONTROLS) & (F.abs("_d") > 1e-12))
            .select(*by, "n", solve("xe", "pe").alias("m00"), solve2("xe", "pe").alias("m01"),
                    solve("xn", "pn").alias("m10"), solve2("xn", "pn").alias("m11")))


def choose_by_rmse(controls: DataFrame, fit: DataFrame, prior: DataFrame, by=("route_id", "page")) -> DataFrame:
    """Affine against prior transform: RMSE of both, largest affine error, and whether the affine is taken.

    prior: by..., sx, sy, theta. Both frames are relative to the first control (smallest x, then y) for the prior.
    """
    by = list(by)
    first = controls.groupBy(*by).agg(F.min(F.struct("x", "y")).alias("_f"))
    rows = controls.join(first, by).join(fit.drop("n"), by).join(prior, by)
    e = F.col("m00") * F.col("x") - F.col("m01") * F.col("y") - F.col("e_rel")
    n = F.col("m10") * F.col("x") - F.col("m11") * F.col("y") - F.col("n_rel")
    here, base = (page_to_utm(x, y, 0.0, 0.0, "sx", "sy", "theta") for x, y in (("x", "y"), ("_f.x", "_f.y")))
    pe = here["easting"] - base["easting"] - F.col("e_rel")
    pn = here["northing"] - base["northing"] - F.col("n_rel")
    stats = rows.groupBy(*by).agg(F.sqrt(F.avg(e * e + n * n)).alias("rmse_fit"), F.max(F.sqrt(e * e + n * n)).alias("max_err"),
                                  F.sqrt(F.avg(pe * pe + pn * pn)).alias("rmse_prior"))
    return stats.withColumn("use_fit", (F.col("rmse_fit") < F.col("rmse_prior")) & (F.col("max_err") <= MAX_CONTROL_ERROR_M))


def similarity_fit(pairs: DataFrame, by) -> DataFrame:
    """Rotation, scale and shift taking (px, py) to (qx, qy) per key: q = scale·R(theta)·p + t, no reflection."""
    by = [by] if isinstance(by, str) else list(by)
    s = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("px").alias("mpx"), F.avg("py").alias("mpy"), F.avg("qx").alias("mqx"), F.avg("qy").alias("mqy"),
        (F.covar_pop("qx", "px") + F.covar_pop("qy", "py")).alias("a"), (F.covar_pop("qx", "py") - F.covar_pop("qy", "px")).alias("b"),
        (F.var_pop("px") + F.var_pop("py")).alias("v"))
    s = s.where((F.col("n") >= 2) & (F.col("v") * F.col("n") >= 1e-6))
    s = s.withColumns({"theta": F.atan2("b", "a"), "scale": F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")) / F.col("v")})
    s = s.where(F.col("scale") >= 1e-9)
    c, d = F.cos("theta"), F.sin("theta")
    return s.select(*by, "n", "scale", "theta",
                    (F.col("mqx") - F.col("scale") * (c * F.col("mpx") + d * F.col("mpy"))).alias("tx"),
                    (F.col("mqy") - F.col("scale") * (c * F.col("mpy") - d * F.col("mpx"))).alias("ty"))


def apply_similarity(points: DataFrame, fit: DataFrame, by, x: str = "e", y: str = "n") -> DataFrame:
    """Move (x, y) by the fit of their key; keys without a fit keep their points."""
    by = [by] if isinstance(by, str) else list(by)
    turned = rotate(x, y, F.col("theta"))
    rows = points.join(fit.select(*by, "scale", "theta", "tx", "ty"), by, "left").withColumn("_r", turned)
    return (rows.withColumns({x: F.coalesce(F.col("scale") * F.col("_r.x") + F.col("tx"), F.col(x)),
                              y: F.coalesce(F.col("scale") * F.col("_r.y") + F.col("ty"), F.col(y))})
            .drop("scale", "theta", "tx", "ty", "_r"))


def two_point_refit(poles: DataFrame, anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """Similarity through each route's anchors, taken only within 6 degrees, 6 % scale and 0.5 m of label RMSE.

    poles: route_id, number, e, n; anchors: route_id, number, ae, an. Adds `refit`.
    """
    pairs = poles.join(anchors, ["route_id", "number"]).selectExpr("route_id", "e AS px", "n AS py", "ae AS qx", "an AS qy")
    fit = similarity_fit(pairs, "route_id")
    small = (F.abs(F.degrees("theta")) <= REFIT_MAX_DEG) & (F.abs(F.col("scale") - 1) <= REFIT_MAX_SCALE)
    fit = fit.where(small)
    moved = apply_similarity(poles.select("route_id", "number", "e", "n"), fit, "route_id")
    fine = lambda p, name: _pole_ends(p, spans.where(F.col("meters") > 0), ["e", "n"]).groupBy("route_id").agg(
        F.sqrt(F.avg(F.pow(dist2d("a_e", "a_n", "b_e", "b_n") - F.col("meters"), F.lit(2.0)))).alias(name))
    gate = fine(poles, "_before").join(fine(moved, "_after"), "route_id").where(F.col("_after") <= F.col("_before") + REFIT_MAX_RMSE_GAIN)
    good = fit.join(gate.select("route_id"), "route_id", "left_semi")
    flagged = apply_similarity(poles.select("route_id", "number", "e", "n"), good, "route_id")
    return flagged.join(good.select("route_id", F.lit(True).alias("refit")), "route_id", "left").fillna({"refit": False})


def regression_bearing(points: DataFrame, by) -> DataFrame:
    """Bearing of the line of best fit of x and y against the pole's rank; null for under three poles."""
    by = [by] if isinstance(by, str) else list(by)
    ranked = ordered_scan(points, by, "number", chunk=number_chunk(), cumsum={"_i": F.lit(1)})
    slopes = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("x", "_i").alias("_dx"), F.regr_slope("y", "_i").alias("_dy"))
    bearing = F.pmod(F.degrees(F.atan2(F.col("_dx"), -F.col("_dy"))) + 360, F.lit(360.0))
    return slopes.select(*by, "n", F.when(F.col("n") >= 3, bearing).alias("bearing"))


def _axis(y, x):
    """Half the angle of (x, y), its cosine and sine, by the C library: the last digit of Java's functions differs from it."""
    import pandas as pd
    theta = [0.5 * math.atan2(a, b) for a, b in zip(y.tolist(), x.tolist())]
    return pd.DataFrame({"theta": theta, "ux": [math.cos(t) for t in theta], "uy": [math.sin(t) for t in theta]}, dtype=float)


def principal_axis(points: DataFrame, by) -> DataFrame:
    """Direction of largest spread: (by..., theta, ux, uy).

    Moments differ in their last digits with the order in which rows are merged. Where the true covariance, or the
    difference of the variances, is zero, that alone would turn the axis round; what is no more than rounding counts as zero.
    Marks often stand exactly on a border along the axis (slopes of 3 to 4 and the like), where the last digit decides;
    so the angle is taken by the library that DuckDB uses, for one row a key.
    """
    by = [by] if isinstance(by, str) else list(by)
    cov, vx, vy = F.covar_pop("x", "y"), F.var_pop("x"), F.var_pop("y")
    settled = lambda c, scale: F.when(F.abs(c) <= NOISE * scale, 0.0).otherwise(c)
    rows = points.groupBy(*by).agg((2 * settled(cov, F.sqrt(vx * vy))).alias("_s"), settled(vx - vy, vx + vy).alias("_d"))
    axis = F.pandas_udf(_axis, "theta double, ux double, uy double")("_s", "_d")
    known = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    return rows.withColumn("_a", axis).select(*by, *(F.when(known, F.col(f"_a.{c}")).alias(c) for c in ("theta", "ux", "uy")))


def page_transforms(viewports: DataFrame, pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Page transforms from viewport geometry and one anchor pole per route.

    viewports: route_id, page, vx, vy, vw, vh (boxes on the overview); pages: route_id, page, page_w, theta,
    grid_scale (null where the page has no grid); anchors: route_id, page, x, y, lat, lon, overview_scale.
    A page's scale is its grid's, else its box ratio; a page without a measured rotation takes the anchor page's.
    """
    boxes = viewports.join(pages, PAGE)
    own = F.coalesce("grid_scale", F.col("vw") / F.col("page_w") * F.col("overview_scale"))
    start = (anchors.join(boxes, PAGE).withColumn("_u", utm_forward("lat", "lon")).withColumn("_s", own)
             .withColumn("_r", rotate("x", "y", F.coalesce("theta", F.lit(0.0))))
             .select("route_id", F.col("page").alias("_apage"), "overview_scale", F.col("_u.zone").alias("zone"),
                     F.coalesce("theta", F.lit(0.0)).alias("_atheta"), F.col("vx").alias("_avx"), F.col("vy").alias("_avy"),
                     (F.col("_u.easting") - F.col("_r.x") * F.col("_s")).alias("_oe"), (F.col("_u.northing") + F.col("_r.y") * F.col("_s")).alias("_on")))
    rows = boxes.join(start, "route_id")
    theta = F.when(F.coalesce("theta", F.lit(0.0)) != 0, F.col("theta")).otherwise(F.col("_atheta"))
    return rows.select(
        *PAGE, (F.col("_oe") + (F.col("vx") - F.col("_avx")) * F.col("overview_scale")).alias("origin_e"),
        (F.col("_on") - (F.col("vy") - F.col("_avy")) * F.col("overview_scale")).alias("origin_n"),
        own.alias("sx"), own.alias("sy"), theta.alias("theta"), "zone")
