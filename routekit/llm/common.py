"""What the text operators share: words, whole-text helpers, query registration."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
SPACE = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) as a query; `sql` is what DuckDB must return."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def words(text: Column) -> Column:
    """The runs of other characters than space, tab and line ends; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def literal_array(values, kind: str) -> Column:
    """A constant array that the optimizer folds to one literal; the caller proves its size."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def rest_of(df: DataFrame, *taken: str) -> list[str]:
    return [c for c in df.columns if c not in taken]


def most_frequent(found: DataFrame, n: int, counters: int = 1 << 17) -> list[str]:
    """The n most frequent values of column `w`, ties in order of the values, exactly counted.

    Hash counters, as many for any input, show where frequent values can be; only values of the 4 n fullest counters are
    counted one by one, so few rows reach the driver however many partitions there are."""
    at = F.pmod(F.xxhash64("w"), F.lit(counters))
    full = [r["at"] for r in found.groupBy(at.alias("at")).count().orderBy(F.desc("count"), "at").limit(4 * n).collect()]
    top = found.where(at.isin(full)).groupBy("w").count().orderBy(F.desc("count"), "w").limit(n).collect() if full else []
    return [r["w"] for r in top]


def smallest_hashes(df: DataFrame, n: int, *ties: str) -> DataFrame:
    """At most n rows, those with the smallest 64-bit hash in column `h`; rows far above them are not even sorted."""
    total = df.count()
    if total > 2 * n:
        df = df.where(F.col("h") < F.lit(-(1 << 63) + int((1 << 64) * min(1.0, 1.3 * n / total) * 0.999)))
    return df.orderBy("h", *ties).limit(n)
