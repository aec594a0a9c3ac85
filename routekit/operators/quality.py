"""Residuals, trust gates, tiers and regression checks."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routekit.functions import (AUTHORITATIVE_SOURCES, INVENTED_SOURCES, accuracy_tier, dist2d, haversine_m)
from routekit.operators.core import nearest, nearest_rank_95, rank_values, true_median, upper_median

# Decision bands (relative error; metres).
SHAPE_TRUST, SHAPE_FAIL = 0.05, 0.15
GAP_TRUST_M, GAP_LOW_M, GAP_FAIL_M = 10.0, 15.0, 20.0
TIERS_BY_SEVERITY = ["HIGH", "MED", "LOW", "UNRESOLVABLE"]
REL_WIDTH, METRE_WIDTH = 0.5, 50.0


def _ends(poles: DataFrame, prefix: str, number: str) -> DataFrame:
    known = poles.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return known.select("route_id", F.col("number").alias(number), F.col("lat").alias(f"{prefix}_lat"), F.col("lon").alias(f"{prefix}_lon"))


def residuals(poles: DataFrame, spans: DataFrame) -> DataFrame:
    """Printed against computed length for every labelled span whose poles both have positions."""
    hav = haversine_m("a_lat", "a_lon", "b_lat", "b_lon")
    gap = F.abs(F.col("hav") - F.col("printed"))
    return (spans.where(F.col("meters") > 0)
            .select("route_id", "lo", "hi", F.col("meters").alias("printed"), "source")
            .join(_ends(poles, "a", "lo"), ["route_id", "lo"]).join(_ends(poles, "b", "hi"), ["route_id", "hi"])
            .withColumn("hav", hav)
            .select("route_id", "lo", "hi", "printed", "hav", (gap / F.col("printed")).alias("rel_error"),
                    gap.alias("residual_m"), "source"))


def residual_summary(residual_rows: DataFrame) -> DataFrame:
    """Upper median and nearest-rank p95 of the relative error per route."""
    return (rank_values(residual_rows, "route_id", "rel_error", {"median_rel": upper_median, "p95_rel": nearest_rank_95}, width=REL_WIDTH)
            .withColumnRenamed("n", "edge_count"))


def anchor_gaps(paired: DataFrame, anchored: DataFrame) -> DataFrame:
    """Distance between two position sets of the same poles."""
    return (_ends(paired, "a", "number").join(_ends(anchored, "b", "number"), ["route_id", "number"])
            .select("route_id", "number", haversine_m("a_lat", "a_lon", "b_lat", "b_lon").alias("gap_m")))


def anchor_gap_summary(gaps: DataFrame) -> DataFrame:
    p95 = rank_values(gaps, "route_id", "gap_m", {"p95_gap": nearest_rank_95}, width=METRE_WIDTH).drop("n")
    mean = gaps.groupBy("route_id").agg(F.avg("gap_m").alias("mean_gap"), F.count("*").alias("pole_count"))
    return mean.join(p95, "route_id")


def median_crossval(spans: DataFrame, edges: DataFrame, by: str, factor: float = 2.0, tol_fraction: float = 0.15, window: float = 2.0) -> DataFrame:
    """Do printed spans and drawn base spans agree in scale? (ok, reason, medians, ratio, tolerances) per key."""
    printed = true_median(spans.where(F.col("meters") > 0), by, "meters", "median_printed", width=METRE_WIDTH).drop("n")
    drawn_rows = edges.withColumn("_span", dist2d("ax", "ay", "bx", "by")).where(F.col("_span") > 0)
    drawn = true_median(drawn_rows, by, "_span", "median_drawn", width=METRE_WIDTH).drop("n")
    both = printed.join(drawn, by, "full_outer").withColumn("ratio", F.col("median_printed") / F.col("median_drawn"))
    reason = F.when(F.col("ratio").isNull(), "insufficient-data").when(~F.col("ratio").between(1 / factor, factor), "scale-mismatch")
    ok = F.col("reason").isNull()
    return (both.withColumn("reason", reason)
            .select(by, ok.alias("ok"), "reason", "median_printed", "median_drawn", "ratio",
                    F.when(ok, tol_fraction * F.col("median_printed")).alias("span_tol_m"),
                    F.when(ok, window * F.col("median_printed")).alias("window_m")))


def span_rmse(poles: DataFrame, spans: DataFrame, frame: str = "gps") -> DataFrame:
    """RMSE of computed span lengths against printed ones; frame is gps (lat, lon) or utm (e, n)."""
    if frame == "gps":
        errors = residuals(poles, spans).select("route_id", "residual_m")
    else:
        end = lambda s, n: poles.select("route_id", F.col("number").alias(n), F.col("e").alias(f"{s}e"), F.col("n").alias(f"{s}n"))
        errors = (spans.where(F.col("meters") > 0).join(end("a", "lo"), ["route_id", "lo"]).join(end("b", "hi"), ["route_id", "hi"])
                  .select("route_id", (dist2d("ae", "an", "be", "bn") - F.col("meters")).alias("residual_m")))
    return errors.groupBy("route_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("residual_m") * F.col("residual_m"))).alias("rmse"))


def label_degree(spans: DataFrame, trusted_only: bool = False) -> DataFrame:
    """Distinct labelled neighbours per pole; optionally over authoritative sources only."""
    rows = spans.where(F.col("meters") > 0)
    if trusted_only:
        rows = rows.where(F.col("source").isin(AUTHORITATIVE_SOURCES))
    ends = F.explode(F.array(F.struct(F.col("lo").alias("number"), F.col("hi").alias("other")),
                             F.struct(F.col("hi").alias("number"), F.col("lo").alias("other"))))
    return (rows.select("route_id", ends.alias("p")).select("route_id", "p.*").distinct()
            .groupBy("route_id", "number").agg(F.count("*").alias("degree")))


def worst_incident(residual_rows: DataFrame) -> DataFrame:
    """Worst incident edge per pole, with its metres."""
    ends = F.explode(F.array("lo", "hi")).alias("number")
    worst = F.max(F.struct("rel_error", "residual_m"))
    return (residual_rows.select("route_id", ends, "rel_error", "residual_m").groupBy("route_id", "number")
            .agg(worst.alias("_w")).select("route_id", "number", F.col("_w.rel_error").alias("worst_rel"), F.col("_w.residual_m").alias("worst_m")))


def route_decision(shape: DataFrame, gap: DataFrame, advisory: bool = False) -> DataFrame:
    """trust / fallback / fail per route from the shape median and the anchor p95."""
    rows = shape.join(gap, "route_id", "full_outer")
    yes = lambda c: F.coalesce(c, F.lit(False))
    shape_ok, shape_bad = yes(F.col("median_rel") < SHAPE_TRUST), yes(F.col("median_rel") >= SHAPE_FAIL)
    gap_ok, gap_bad = yes(F.col("p95_gap") < GAP_TRUST_M), yes(F.col("p95_gap") >= GAP_FAIL_M)
    trust, fail = (shape_ok, shape_bad) if advisory else (shape_ok & gap_ok, shape_bad | gap_bad)
    return rows.withColumn("decision", F.when(trust, "trust").when(fail, "fail").otherwise("fallback"))


def pole_tiers(universe: DataFrame, worst: DataFrame, gaps: DataFrame, advisory: bool = False) -> DataFrame:
    """HIGH / MED / LOW / UNRESOLVABLE for every declared or scored pole."""
    key = ["route_id", "number"]
    rows = (universe.select(*key).distinct().join(worst, key, "full_outer").join(gaps.select(*key, "gap_m"), key, "full_outer"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    high, low = yes(F.col("worst_rel") < SHAPE_TRUST), yes(F.col("worst_rel") >= SHAPE_FAIL)
    if not advisory:
        high, low = high & yes(F.col("gap_m") < GAP_TRUST_M), low | yes(F.col("gap_m") >= GAP_LOW_M)
    tier = (F.when(F.col("worst_rel").isNull() & F.col("gap_m").isNull(), "UNRESOLVABLE")
            .when(high, "HIGH").when(low, "LOW").otherwise("MED"))
    return rows.select(*key, tier.alias("tier"), F.col("worst_m").alias("shape_residual_m"), F.col("gap_m").alias("anchor_gap_m"))


def worst_tier(tiers: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS_BY_SEVERITY]), F.col("tier"))
    return tiers.groupBy("route_id").agg(F.max_by("tier", rank).alias("worst"))


def overall_tier(decision: DataFrame, tiers: DataFrame) -> DataFrame:
    rows = decision.select("route_id", "decision").join(worst_tier(tiers), "route_id", "left")
    overall = (F.when((F.col("decision") == "trust") & (F.coalesce(F.col("worst"), F.lit("HIGH")) == "HIGH"), "high")
               .when(F.col("worst") == "UNRESOLVABLE", "unresolvable").when(F.col("worst") == "LOW", "low")
               .when(F.col("worst").isin("MED", "HIGH"), "med").otherwise("low"))
    return rows.withColumn("overall", overall)


def accept_bar(residual_rows: DataFrame, topology: DataFrame) -> DataFrame:
    """Accept a solved route: trusted-label shape below 5 % and topology intact. topology: (route_id, ok)."""
    trusted = residual_summary(residual_rows.where(~F.coalesce(F.col("source").isin(INVENTED_SOURCES), F.lit(False))))
    rows = topology.join(trusted, "route_id", "left")
    shape_ok = F.coalesce(F.col("median_rel") < SHAPE_TRUST, F.lit(False))
    reason = F.when(~shape_ok, "residual-gate").when(~F.col("ok"), "topology")
    return rows.select("route_id", reason.isNull().alias("accepted"), reason.alias("reason"), "median_rel")


def compare_truth(result: DataFrame, truth: DataFrame) -> DataFrame:
    """Every truth pole with its error; null where the result has no position."""
    placed = _ends(result, "r", "number")
    return (truth.where(F.col("lat").isNotNull()).select("route_id", "number", F.col("lat").alias("true_lat"), F.col("lon").alias("true_lon"))
            .join(placed, ["route_id", "number"], "left")
            .select("route_id", "number", haversine_m("true_lat", "true_lon", "r_lat", "r_lon").alias("err_m")))


def tier_histogram(errors: DataFrame) -> DataFrame:
    """perfect / good / acceptable / bad counts per route, unmatched apart."""
    tier = accuracy_tier("err_m")
    counts = [F.count_if(tier == t).alias(t) for t in ("perfect", "good", "acceptable", "bad")]
    return errors.groupBy("route_id").agg(*counts, F.count_if(F.col("err_m").isNull()).alias("unmatched"))


def bad_poles(errors: DataFrame) -> DataFrame:
    return errors.where(F.col("err_m") > 15)


def error_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("route_id").agg(F.count("err_m").alias("matched"), F.count("*").alias("declared"),
                                          F.avg("err_m").alias("mean_err_m"), F.max("err_m").alias("max_err_m"))


def error_ceilings(errors: DataFrame) -> DataFrame:
    """Recorded ceiling per pole: half a metre of slack, rounded up to a decimetre."""
    return errors.where(F.col("err_m").isNotNull()).select("route_id", "number", (F.ceil((F.col("err_m") + 0.5) * 10) / 10).alias("ceiling_m"))


def regression_gate(errors: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Per route: poles above their recorded ceiling or gone missing."""
    rows = ceilings.join(errors, ["route_id", "number"], "left")
    return (rows.groupBy("route_id").agg(F.count_if(F.col("err_m").isNull()).alias("missing"),
                                         F.count_if(F.col("err_m") > F.col("ceiling_m")).alias("over"))
            .withColumn("passed", (F.col("missing") == 0) & (F.col("over") == 0)))


def bad_tier_gate(errors: DataFrame, excluded: DataFrame, soft: bool = False) -> DataFrame:
    """No pole may be worse than 15 m, apart from the excluded ones; soft mode reports without failing."""
    scoped = errors.join(excluded.select("route_id", "number"), ["route_id", "number"], "left_anti")
    counts = scoped.groupBy("route_id").agg(F.count_if(F.col("err_m") > 15).alias("bad"))
    return counts.withColumn("passed", F.lit(True) if soft else F.col("bad") == 0)


def position_gate(poles: DataFrame, truth: DataFrame, tol: float = 50.0) -> DataFrame:
    """Page-point error per truth pole; a missing pole fails."""
    at = poles.select("route_id", "number", F.col("x").alias("_x"), F.col("y").alias("_y"))
    rows = truth.join(at, ["route_id", "number"], "left").withColumn("err_pt", dist2d("x", "y", "_x", "_y"))
    return rows.select("route_id", "number", "err_pt", F.coalesce(F.col("err_pt") <= tol, F.lit(False)).alias("passed"))


def cascade(results: DataFrame) -> DataFrame:
    """First accepted method per route, with the reasons of the methods that were passed over.

    results: (route_id, priority, method, accepted, reason); a route with no accepted method keeps method null.
    """
    chosen = results.groupBy("route_id").agg(
        F.min_by(F.when(F.col("accepted"), F.col("method")), F.when(F.col("accepted"), F.col("priority"))).alias("method"),
        F.min(F.when(F.col("accepted"), F.col("priority"))).alias("priority"))
    passed_over = (results.join(chosen.withColumnRenamed("priority", "_won").drop("method"), "route_id")
                   .where(F.col("_won").isNull() | (F.col("priority") < F.col("_won"))))
    why = passed_over.groupBy("route_id").agg(F.array_sort(F.collect_set(F.struct("priority", "method", "reason"))).alias("demotions"))
    return chosen.join(why, "route_id", "left")


def missing_regions(points: DataFrame, located: DataFrame, regions: DataFrame) -> DataFrame:
    """Points that no region covers, with the nearest known region.

    Points (point_id, lat, lon), located (point_id). Nearest by chord length on the unit sphere, which orders like the
    great-circle distance.
    """
    def sphere(df, lat, lon, prefix):
        la, lo = F.radians(lat), F.radians(lon)
        return df.withColumns({f"{prefix}x": F.cos(la) * F.cos(lo), f"{prefix}y": F.cos(la) * F.sin(lo), f"{prefix}z": F.sin(la)})

    missed = points.join(located.select("point_id"), "point_id", "left_anti")
    spots = sphere(missed.select("lat", "lon").distinct().withColumn("lid", F.struct("lat", "lon")), F.col("lat"), F.col("lon"), "l")
    middle = regions.withColumns({"c_lat": (F.col("min_lat") + F.col("max_lat")) / 2, "c_lon": (F.col("min_lon") + F.col("max_lon")) / 2})
    centres = sphere(middle.withColumn("rid", F.col("region_id")), F.col("c_lat"), F.col("c_lon"), "r")
    hit = nearest(spots, centres, start=0.002, growth=8, payload=("name", "c_lat", "c_lon"), dims=3)
    found = hit.select(F.col("lid.lat").alias("lat"), F.col("lid.lon").alias("lon"), F.col("rid").alias("nearest_id"), F.col("name").alias("nearest_name"),
                       (haversine_m("lid.lat", "lid.lon", "c_lat", "c_lon") / 1000).alias("distance_km"))
    return missed.join(found, ["lat", "lon"], "left")


def drop_far_points(truth: DataFrame, km: float = 2.0) -> DataFrame:
    """Keep the points within `km` of the component-wise median of their route."""
    lat = true_median(truth, "route_id", "lat", "_mlat", width=0.002).drop("n")
    lon = true_median(truth, "route_id", "lon", "_mlon", width=0.002).drop("n")
    far = haversine_m("lat", "lon", "_mlat", "_mlon") > km * 1000
    return truth.join(lat, "route_id").join(lon, "route_id").where(~far).drop("_mlat", "_mlon")


def bbox(points: DataFrame, by, x: str = "x", y: str = "y", margin: float = 0.0) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return points.groupBy(*by).agg((F.min(x) - margin).alias("min_x"), (F.min(y) - margin).alias("min_y"),
                                   (F.max(x) + margin).alias("max_x"), (F.max(y) + margin).alias("max_y"))


def chain_stats(spans: DataFrame) -> DataFrame:
    """Labelled chain length, count and median label per route."""
    active = spans.where(F.col("meters") > 0)
    middle = true_median(active, "route_id", "meters", "median_m", width=METRE_WIDTH)
    return active.groupBy("route_id").agg(F.sum("meters").alias("total_m")).join(middle, "route_id")


def build_stats(poles: DataFrame, lines: DataFrame) -> DataFrame:
    """Document counts per route. lines: (route_id, n_points, missing_gps)."""
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    a = poles.groupBy("route_id").agg(F.count_if(placed).alias("placemarks"), F.count_if(~placed).alias("omitted"))
    drawn = ~F.col("missing_gps") & (F.col("n_points") >= 2)
    b = lines.groupBy("route_id").agg(F.count_if(drawn).alias("lines"), F.count_if(~drawn).alias("skipped"))
    zero = {c: 0 for c in ("placemarks", "omitted", "lines", "skipped")}
    return a.join(b, "route_id", "full_outer").fillna(zero)
