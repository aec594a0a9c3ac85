"""Region catalogue and base-map lookups."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routekit.functions import dist2d, in_bbox
from routekit.operators.core import nearest


def _covering(df: DataFrame, low_x, low_y, high_x, high_y, size: float) -> DataFrame:
    """One row per grid cell a box touches."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    return df.withColumn("_c0", F.explode(span(low_x, high_x))).withColumn("_c1", F.explode(span(low_y, high_y)))


def regions_at(points: DataFrame, regions: DataFrame, cell: float = 0.5) -> DataFrame:
    """All (point, region) containments: an equi-join on degree cells, then the exact box test."""
    boxes = _covering(regions, "min_lat", "min_lon", "max_lat", "max_lon", cell)
    spots = points.withColumns({"_c0": F.floor(F.col("lat") / cell), "_c1": F.floor(F.col("lon") / cell)})
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))
    return spots.join(boxes, ["_c0", "_c1"]).where(inside).drop("_c0", "_c1")


def lookup_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(point_id, region_id): the covering region with the smallest box; ties go to the smallest id."""
    area = (F.col("max_lat") - F.col("min_lat")) * (F.col("max_lon") - F.col("min_lon"))
    return (regions_at(points.select("point_id", "lat", "lon"), regions.withColumn("area", area))
            .groupBy("point_id").agg(F.min_by("region_id", F.struct("area", "region_id")).alias("region_id")))


def _boxes(poles: DataFrame, margin: float) -> DataFrame:
    known = poles.where(F.col("e").isNotNull() & F.col("n").isNotNull())
    return known.groupBy("route_id", "region_id").agg(
        (F.min("e") - margin).alias("min_x"), (F.min("n") - margin).alias("min_y"),
        (F.max("e") + margin).alias("max_x"), (F.max("n") + margin).alias("max_y"))


def crop_poles(region_poles: DataFrame, poles: DataFrame, margin: float = 200.0, cell: float = 500.0) -> DataFrame:
    """Base poles inside each route's bounding box (+margin). poles: (route_id, region_id, e, n)."""
    boxes = _covering(_boxes(poles, margin), "min_x", "min_y", "max_x", "max_y", cell)
    spots = region_poles.withColumns({"_c0": F.floor(F.col("x") / cell), "_c1": F.floor(F.col("y") / cell)})
    hit = spots.join(boxes, ["region_id", "_c0", "_c1"]).where(in_bbox("x", "y", "min_x", "min_y", "max_x", "max_y"))
    return hit.drop("_c0", "_c1", "min_x", "min_y", "max_x", "max_y")


def crop_edges(region_edges: DataFrame, poles: DataFrame, margin: float = 200.0, cell: float = 500.0) -> DataFrame:
    """Base edges with both ends inside the box."""
    boxes = _covering(_boxes(poles, margin), "min_x", "min_y", "max_x", "max_y", cell)
    spots = region_edges.withColumns({"_c0": F.floor(F.col("ax") / cell), "_c1": F.floor(F.col("ay") / cell)})
    box = ("min_x", "min_y", "max_x", "max_y")
    hit = spots.join(boxes, ["region_id", "_c0", "_c1"]).where(in_bbox("ax", "ay", *box) & in_bbox("bx", "by", *box))
    return hit.drop("_c0", "_c1", *box)


def snap_adjacency(region_poles: DataFrame, region_edges: DataFrame, tol: float = 3.0) -> DataFrame:
    """(region_id, u, v, w), both directions: poles joined by an edge whose ends snap to them within `tol`."""
    poles = region_poles.selectExpr("region_id", "idx AS rid", "x AS rx", "y AS ry")
    ends = region_edges.select("region_id", "edge_id", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("ax").alias("x"), F.col("ay").alias("y")),
        F.struct(F.lit(1).alias("side"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    left = ends.select("region_id", F.struct("edge_id", "p.side").alias("lid"), F.col("p.x").alias("lx"), F.col("p.y").alias("ly"))
    snapped = nearest(left, poles.withColumns({"px": F.col("rx"), "py": F.col("ry")}), ["region_id"], start=tol, limit=tol, payload=("px", "py"))
    end = lambda side: snapped.where(F.col("lid.side") == side).select(
        "region_id", F.col("lid.edge_id").alias("edge_id"), *[F.col(c).alias(f"{c}{side}") for c in ("rid", "px", "py")])
    pairs = end(0).join(end(1), ["region_id", "edge_id"]).where("rid0 <> rid1")
    w = dist2d("px0", "py0", "px1", "py1")
    both = F.explode(F.array(F.struct(F.col("rid0").alias("u"), F.col("rid1").alias("v")), F.struct(F.col("rid1").alias("u"), F.col("rid0").alias("v"))))
    return pairs.select("region_id", both.alias("e"), w.alias("w")).select("region_id", "e.*", "w").distinct()


def upsert_regions(catalogue: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest record per region id; an incoming record wins a tie."""
    rows = catalogue.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    fields = [c for c in catalogue.columns if c != "region_id"]
    return (rows.groupBy("region_id").agg(F.max_by(F.struct(*fields), F.struct("uploaded_at", "_in")).alias("_r"))
            .select("region_id", "_r.*").select(*catalogue.columns))


def delete_regions(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    return catalogue.join(ids.select("region_id"), "region_id", "left_anti")


def list_regions(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("region_id", "name", "uploaded_at", "min_lat", "max_lat", "min_lon", "max_lon")


def merge_catalogues(local: DataFrame, shared: DataFrame) -> DataFrame:
    """Two listings merged by id: shared fields win, newest timestamp, and where each record came from."""
    a = local.select("region_id", F.col("name").alias("_n0"), F.col("uploaded_at").alias("_t0"))
    b = shared.select("region_id", F.col("name").alias("_n1"), F.col("uploaded_at").alias("_t1"))
    origin = (F.when(F.col("_t0").isNotNull() & F.col("_t1").isNotNull(), "local+shared")
              .when(F.col("_t1").isNotNull(), "shared").otherwise("local"))
    return a.join(b, "region_id", "full_outer").select(
        "region_id", F.coalesce("_n1", "_n0").alias("name"), F.greatest("_t0", "_t1").alias("uploaded_at"), origin.alias("origin"))
