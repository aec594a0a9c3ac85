"""Layer routing, validation and plausibility filters."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routekit.functions import (haversine_m, in_country, in_zone_envelope, utm_inverse, utm_zone)

# Layer names by role. Names compare without case and accents.
ROLE_NAMES = {"pole_label": ["TEXTO", "Numero_Poste", "Poste"], "sequence_number": ["TEXTO", "Numero_Poste"],
              "span_label": ["Distância_Poste"], "circle": ["0", "Numero_Poste"], "pole_graphic": ["Poste"],
              "utm_grid": ["UTM"], "viewport": ["Padrão"]}
ROLE_PARTS = {"pole_label": [("moldura", "intelig")], "sequence_number": [("moldura", "intelig")],
              "circle": [("numero", "poste")]}
ROLE_PREFIXES = {"pole_label": ["texto_"], "sequence_number": ["texto_"]}
REQUIRED_LAYERS = ["Numero_Poste", "TEXTO", "Distância_Poste", "Cabo Projetado"]

_FOLD = "UNICODE_CI_AI"


def _folded(name) -> Column:
    return F.collate(F.col(name) if isinstance(name, str) else name, _FOLD)


def role_matches(layer, role: str) -> Column:
    """Does a raw layer name play the role?"""
    name = _folded(layer)
    hit = F.lit(False)
    for exact in ROLE_NAMES.get(role, []):
        hit = hit | (name == F.lit(exact))
    for first, second in ROLE_PARTS.get(role, []):
        hit = hit | (F.contains(name, F.collate(F.lit(first), _FOLD)) & F.contains(name, F.collate(F.lit(second), _FOLD)))
    for prefix in ROLE_PREFIXES.get(role, []):
        hit = hit | F.startswith(name, F.collate(F.lit(prefix), _FOLD))
    return F.coalesce(hit, F.lit(False))


def with_layer_role(items: DataFrame, layer: str = "layer") -> DataFrame:
    """Add `roles`, the array of roles a layer plays, in name order. Names are matched once each, then joined back."""
    found = F.array(*[F.when(role_matches("_name", r), F.lit(r)) for r in sorted(ROLE_NAMES)])
    names = items.select(F.col(layer).alias("_name")).distinct().select("_name", F.array_compact(found).alias("roles"))
    return items.join(names, F.col(layer).eqNullSafe(F.col("_name")), "left").drop("_name")


def missing_layers(layers: DataFrame, required=tuple(REQUIRED_LAYERS)) -> DataFrame:
    """(route_id, missing[]) for routes that lack a required layer; one aggregate, no cross join."""
    flags = layers.groupBy("route_id").agg(
        *[F.bool_or(_folded("layer") == F.lit(r)).alias(f"_r{i}") for i, r in enumerate(required)])
    lacking = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"_r{i}"), F.lit(False)), F.lit(r))
                                        for i, r in enumerate(required)]))
    return flags.select("route_id", lacking.alias("missing")).where(F.size("missing") > 0)


def with_fallback(primary: DataFrame, fallback: DataFrame, by=("route_id",)) -> DataFrame:
    """Primary rows, plus fallback rows of the groups that have no primary row."""
    return primary.unionByName(fallback.join(primary.select(*by).distinct(), list(by), "left_anti"))


def plausible_numbers(readings: DataFrame) -> DataFrame:
    """Add in_range: the number lies in 1..count of readings of the route."""
    counts = readings.groupBy("route_id").agg(F.count("*").alias("n_readings"))
    return (readings.join(counts, "route_id")
            .withColumn("in_range", F.coalesce(F.col("number").between(1, F.col("n_readings")), F.lit(False))))


def suspicious_numbering(poles: DataFrame) -> DataFrame:
    """Routes whose highest number exceeds three times their pole count."""
    return (poles.groupBy("route_id").agg(F.max("number").alias("max_number"), F.count("*").alias("n_poles"))
            .where(F.col("max_number") > 3 * F.col("n_poles")))


def resolve_georeference(extents: DataFrame, region_poles: DataFrame, zone: int = 22) -> DataFrame:
    """Unit and position check of a region: (scale, confidence, error, scaled extents, lat/lon box).

    Absent extents are inferred from the poles; millimetre extents are scaled by 1/1000 with low confidence; anything
    else outside the zone envelope, or outside the country, is an error.
    """
    around = region_poles.groupBy("region_id").agg(
        F.min("x").alias("_px0"), F.min("y").alias("_py0"), F.max("x").alias("_px1"), F.max("y").alias("_py1"))
    absent = F.coalesce((F.col("min_x") == 0) & (F.col("min_y") == 0) & (F.col("max_x") == 0) & (F.col("max_y") == 0),
                        F.lit(True))
    metres = in_zone_envelope("max_x", "max_y")
    milli = in_zone_envelope(F.col("max_x") / 1000, F.col("max_y") / 1000)
    scale = F.when(absent | metres, 1.0).when(milli, 0.001)
    pick = lambda extent, inferred: F.when(absent, F.coalesce(F.col(inferred), F.lit(0.0))).otherwise(F.col(extent) * F.col("scale"))
    out = (extents.join(around, "region_id", "left").withColumn("scale", scale)
           .withColumns({"e0": pick("min_x", "_px0"), "n0": pick("min_y", "_py0"),
                         "e1": pick("max_x", "_px1"), "n1": pick("max_y", "_py1")})
           .withColumns({"_a": utm_inverse("e0", "n0", zone), "_b": utm_inverse("e1", "n1", zone)}))
    inside = in_country("_a.lat", "_a.lon") & in_country("_b.lat", "_b.lon")
    error = F.when(F.col("scale").isNull(), "unit mismatch").when(~absent & ~inside, "outside country")
    return out.select(
        "region_id", "scale",
        F.when(absent, "inferred").when(metres, "high").when(milli, "low").alias("confidence"), error.alias("error"),
        "e0", "n0", "e1", "n1",
        F.least("_a.lat", "_b.lat").alias("min_lat"), F.greatest("_a.lat", "_b.lat").alias("max_lat"),
        F.least("_a.lon", "_b.lon").alias("min_lon"), F.greatest("_a.lon", "_b.lon").alias("max_lon"))


def apply_scale(region_rows: DataFrame, georeference: DataFrame, columns) -> DataFrame:
    """Multiply coordinate columns by the region's resolved scale; regions in error are left out."""
    good = georeference.where(F.col("error").isNull()).select("region_id", "scale")
    joined = region_rows.join(good, "region_id")
    return joined.withColumns({c: F.col(c) * F.col("scale") for c in columns}).drop("scale")


def zone_mismatch(anchors: DataFrame, regions: DataFrame) -> DataFrame:
    """Anchors whose UTM zone is not their region's."""
    found = anchors.withColumn("anchor_zone", utm_zone("lon")).join(regions.select("region_id", "zone"), "region_id")
    return found.where(F.col("anchor_zone") != F.col("zone"))


def tap_legs(spans: DataFrame) -> DataFrame:
    """(route_id, lo, hi) where lo→hi is a tap leg: lo-1 has printed spans to both lo and hi, and lo→hi has none."""
    active = spans.where(F.col("meters") > 0).select("route_id", "lo", "hi").distinct()
    near = active.where("hi = lo + 1").select("route_id", F.col("lo").alias("j"))
    over = active.where("hi = lo + 2").select("route_id", F.col("lo").alias("j"))
    legs = near.join(over, ["route_id", "j"]).where("j >= 1").selectExpr("route_id", "j + 1 AS lo", "j + 2 AS hi")
    return legs.join(active, ["route_id", "lo", "hi"], "left_anti")


def label_sanity(conns: DataFrame, poles: DataFrame) -> DataFrame:
    """Printed non-gap connections whose computed length is off by more than max(5 m, 10 %)."""
    end = lambda p: poles.where(F.col("lat").isNotNull()).selectExpr("route_id", f"number AS {p}", f"lat AS {p}_lat", f"lon AS {p}_lon")
    joined = conns.where((F.col("meters") > 0) & ~F.coalesce(F.col("gap"), F.lit(False))) \
        .join(end("src"), ["route_id", "src"]).join(end("dst"), ["route_id", "dst"])
    hav = haversine_m("src_lat", "src_lon", "dst_lat", "dst_lon")
    return (joined.withColumn("computed_m", hav)
            .where(F.abs(F.col("computed_m") - F.col("meters")) > F.greatest(F.lit(5.0), 0.1 * F.col("meters")))
            .drop("src_lat", "src_lon", "dst_lat", "dst_lon"))


def far_from_cable(hits: DataFrame, max_pt: float = 50.0) -> DataFrame:
    return hits.where(F.col("d") > max_pt)
