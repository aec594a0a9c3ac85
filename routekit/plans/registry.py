"""Collects queries and their oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routekit.plans.views import Views, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(views) as a query; `sql` is its DuckDB equivalent (views are added)."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def r6(c, places: int = 6) -> Column:
    """Round for comparison; adding zero removes a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places) + F.lit(0.0)


def rounded(df: DataFrame, *columns, places: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, places) for c in columns})
