"""Truth text, JSON fixtures, extracted-primitive tables, and result sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routekit.schemas import PATH_OPS, TEXT_ITEMS

# The form of a surveyed position, and of a line that announces one.
_TRUTH = r"(?i)poste\s+(\d+)\s*;\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)"
_PREFIX = r"(?i)^\s*poste\s+\d+"


def read_text_lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def parse_truth(lines: DataFrame) -> DataFrame:
    """Surveyed positions from lines like `Poste 01; -27.6, -48.6;` (any case): file, number, lat, lon."""
    part = lambda i: F.regexp_extract("line", _TRUTH, i)
    return lines.where(F.col("line").rlike(_TRUTH)).select("file", part(1).cast("int").alias("number"), part(2).cast("double").alias("lat"), part(3).cast("double").alias("lon"))


def read_truth_text(spark: SparkSession, paths) -> DataFrame:
    return parse_truth(read_text_lines(spark, paths))


def dropped_lines(lines: DataFrame) -> DataFrame:
    """Lines that announce a pole but do not parse: file, expected, parsed, dropped."""
    counts = lines.groupBy("file").agg(F.count_if(F.col("line").rlike(_PREFIX)).alias("expected"), F.count_if(F.col("line").rlike(_TRUTH)).alias("parsed"))
    return counts.withColumn("dropped", F.greatest(F.lit(0), F.col("expected") - F.col("parsed")))


def read_json_table(spark: SparkSession, path, schema, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def read_primitives(spark: SparkSession, folder: str):
    """(text_items, path_ops) as the drawing input."""
    return spark.read.schema(TEXT_ITEMS).parquet(f"{folder}/text_items"), spark.read.schema(PATH_OPS).parquet(f"{folder}/path_ops")


def overrides_from_json(documents: DataFrame) -> DataFrame:
    """Manual span lengths from {"10->11": 37.3} documents: (route_id, body) to (route_id, lo, hi, meters)."""
    entries = documents.select("route_id", F.explode(F.from_json("body", "map<string,double>")).alias("pair", "meters"))
    end = lambda i: F.regexp_extract("pair", r"^\s*(\d+)\s*->\s*(\d+)\s*$", i).try_cast("int")
    rows = entries.withColumns({"_a": end(1), "_b": end(2)}).where("_a IS NOT NULL AND _b IS NOT NULL AND meters > 0")
    return rows.select("route_id", F.least("_a", "_b").alias("lo"), F.greatest("_a", "_b").alias("hi"), "meters")


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.format(fmt).mode(mode).save(path)


def write_kml(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Document lines (route_id, ord, text) to one folder per route. Range partitioning lets a long route span files;
    files of a route follow each other in name order."""
    ordered = lines.repartitionByRange("route_id", "ord").sortWithinPartitions("route_id", "ord")
    ordered.select("route_id", "text").write.mode(mode).partitionBy("route_id").text(path)


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(value, route_id): the lines that write_kml wrote. Spark would list each of up to 10 000 folders in a task of its own."""
    before = spark.conf.get(LISTING)
    try:
        spark.conf.set(LISTING, str(8 * spark.sparkContext.defaultParallelism))
        return spark.read.schema("value string, route_id bigint").text(path)
    finally:
        spark.conf.set(LISTING, before)
