"""Route-survey views over the driver tables.

Every view is a projection of one whole base table (or a union of two), written once as SQL expressions that Spark and
DuckDB both accept. Routes come from `events` (64 poles each, dense numbers, realistic spans) and from `lineitem`
(messy: duplicate numbers, gaps, several pages).
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_METRES = ("CASE WHEN (event_id % 64 + 1) % 11 = 0 THEN NULL ELSE (27e0 + value / 40e0) * "
           "CASE WHEN floor(event_id / 64e0) % 5 = 0 THEN 1.3e0 ELSE 1e0 END END")
_ROUTE = "CAST(floor(event_id / 64e0) AS BIGINT)"
_NUMBER = "CAST(event_id % 64 + 1 AS INT)"
_PAGE = "CAST(floor((event_id % 64) / 16e0) + 1 AS INT)"
_PX = "(event_id % 16) * 56e0 + (event_id % 5) * 2e0 + 40e0"
_PY = "300e0 + (event_id % 7) * 4e0"

# name -> (base table, {column: expression}, where)
PROJECTIONS = {
    # georeferenced poles with page positions and grid metres
    "v_tracks": ("events", {
        "route_id": _ROUTE, "number": _NUMBER, "page": _PAGE, "x": _PX, "y": _PY,
        "lat": "-27.6e0 - (event_id % 64) * 2.5e-4 - (event_id % 7) * 1e-5",
        "lon": "-48.6e0 - (floor(event_id / 64e0) % 50e0) * 1e-3 - (event_id % 5) * 2e-5",
        "e": "700000e0 + (floor(event_id / 64e0) % 50e0) * 100e0 + (event_id % 5) * 2e0",
        "n": "6900000e0 - (event_id % 64) * 27.7e0 - (event_id % 7) * 1.1e0",
        "source": "event_type", "v": "value", "row_id": "event_id"}, None),
    # printed metres between consecutive poles; null metres are tombstones
    "v_spans": ("events", {
        "route_id": _ROUTE, "lo": _NUMBER, "hi": "CAST(event_id % 64 + 2 AS INT)", "meters": _METRES,
        "source": "CASE WHEN (event_id % 64 + 1) % 11 = 0 THEN 'jumpback-suppressed' "
                  "WHEN event_type = 'error' THEN 'inferred-label' ELSE 'legacy-midpoint' END"}, None),
    # non-consecutive spans: skips and jumps of 2..6 numbers
    "v_jumps": ("events", {
        "route_id": _ROUTE, "lo": _NUMBER, "hi": "CAST(event_id % 64 + 3 + event_id % 5 AS INT)",
        "meters": "CASE WHEN value < 20e0 THEN 27e0 + value / 40e0 ELSE 55e0 + value / 40e0 END",
        "source": "CASE WHEN value > 80e0 THEN 'bifurcation-main' ELSE 'legacy-midpoint' END"},
        "event_type = 'signup'"),
    # surveyed positions, every thirteenth unknown
    "v_truth": ("events", {
        "route_id": _ROUTE, "number": _NUMBER,
        "lat": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE -27.6e0 - (event_id % 64) * 2.5e-4 "
               "- (event_id % 7) * 1e-5 + value / 1000000e0 END",
        "lon": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE -48.6e0 - (floor(event_id / 64e0) % 50e0) * 1e-3 "
               "- (event_id % 5) * 2e-5 END"}, None),
    # printed labels near the middle of each span
    "v_labels": ("events", {
        "route_id": _ROUTE, "item_id": "event_id", "page": _PAGE,
        "str": "replace(CAST(CAST(27e0 + value / 40e0 AS DECIMAL(8,1)) AS VARCHAR(12)), '.', ',')",
        "x": "(event_id % 16) * 56e0 + (event_id % 3) * 6e0 + 62e0", "y": "308e0 + (event_id % 11) * 3e0",
        "width": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 6e0 END"}, None),
    # cable linework: one path per page, vertices shared between neighbours
    "v_segs": ("events", {
        "route_id": _ROUTE, "page": _PAGE, "path_id": "CAST(floor((event_id % 64) / 16e0) AS BIGINT)",
        "seq": "CAST(event_id % 16 AS INT)",
        "ax": "(event_id % 16) * 56e0 + 40e0", "ay": "306e0 + (event_id % 16 % 3) * 4e0",
        "bx": "(event_id % 16 + 1) * 56e0 + 40e0", "by": "306e0 + ((event_id % 16 + 1) % 3) * 4e0"}, None),
    # raw path operators: lines, cubic and quadratic curves, closes; later pages are dashed
    "v_path_ops": ("events", {
        "route_id": _ROUTE, "page": _PAGE, "path_id": "CAST(floor((event_id % 64) / 16e0) AS BIGINT)",
        "seq": "CAST(event_id % 16 AS INT)",
        "op": "CASE WHEN event_id % 16 = 0 OR (event_id % 64 >= 32 AND event_id % 16 % 3 = 0) THEN 'M' "
              "WHEN event_id % 64 = 31 THEN 'Z' WHEN event_id % 4 = 1 THEN 'C' WHEN event_id % 4 = 2 THEN 'Q' ELSE 'L' END",
        "x": "CASE WHEN event_id % 64 = 31 THEN NULL ELSE (event_id % 16) * 56e0 + 40e0 END",
        "y": "CASE WHEN event_id % 64 = 31 THEN NULL ELSE 306e0 + (event_id % 16 % 3) * 4e0 END",
        "x1": "(event_id % 16) * 56e0 - 5e0", "y1": "314e0 + (event_id % 5)",
        "x2": "(event_id % 16) * 56e0 + 20e0", "y2": "300e0 - (event_id % 3)"}, None),
    # map grid linework: alternating verticals and horizontals with jitter
    "v_grid": ("events", {
        "route_id": _ROUTE, "page": _PAGE, "seq": "CAST(event_id % 16 AS INT)",
        "ax": "CASE WHEN event_id % 2 = 0 THEN (event_id % 16) * 60e0 + (event_id % 3) * 0.4e0 ELSE 10e0 END",
        "ay": "CASE WHEN event_id % 2 = 0 THEN 5e0 ELSE (event_id % 16) * 60e0 + (event_id % 3) * 0.4e0 END",
        "bx": "CASE WHEN event_id % 2 = 0 THEN (event_id % 16) * 60e0 + (event_id % 3) * 0.4e0 + 0.5e0 ELSE 900e0 + value END",
        "by": "CASE WHEN event_id % 2 = 0 THEN 800e0 ELSE (event_id % 16) * 60e0 + (event_id % 3) * 0.4e0 + (event_id % 4) END"}, None),
    # pole symbols drawn on the page, unnumbered
    "v_symbols": ("events", {
        "route_id": _ROUTE, "sym_id": "event_id", "page": _PAGE,
        "x": "(event_id % 16) * 56e0 + 40e0 + (event_id % 9) * 1.5e0 + CASE WHEN value > 120e0 THEN 70e0 ELSE 0e0 END",
        "y": "300e0 + (event_id % 6) * 4e0"}, None),
    # surveyed base poles in grid metres, a region per eight routes
    "v_base": ("events", {
        "region_id": "CAST(floor(event_id / 512e0) AS BIGINT)", "route_id": _ROUTE, "idx": "event_id",
        "x": "700000e0 + (floor(event_id / 64e0) % 50e0) * 100e0 + (event_id % 5) * 2e0 + (event_id % 3) * 0.7e0",
        "y": "6900000e0 - (event_id % 64) * 27.7e0 - (event_id % 7) * 1.1e0 + (event_id % 4) * 0.6e0",
        "block": "event_type"}, None),
    # base cable edges, drawn pole to pole with small offsets
    "v_base_edges": ("events", {
        "region_id": "CAST(floor(event_id / 512e0) AS BIGINT)", "poly": _ROUTE, "edge_id": "event_id",
        "kind": "CASE WHEN event_type = 'click' THEN 'primary' ELSE 'secondary' END",
        "ax": "700000e0 + (floor(event_id / 64e0) % 50e0) * 100e0 + (event_id % 5) * 2e0 + 0.4e0",
        "ay": "6900000e0 - (event_id % 64) * 27.7e0 - (event_id % 7) * 1.1e0 + 0.3e0",
        "bx": "700000e0 + (floor(event_id / 64e0) % 50e0) * 100e0 + ((event_id + 1) % 5) * 2e0 + 0.4e0",
        "by": "6900000e0 - (event_id % 64 + 1) * 27.7e0 - ((event_id + 1) % 7) * 1.1e0 + 0.3e0"}, None),
    # OCR readings in page order: some missing, some misread
    "v_readings": ("events", {
        "route_id": _ROUTE, "row_id": "event_id", "pos": _NUMBER, "page": _PAGE, "x": _PX, "y": _PY,
        "number": "CAST(CASE WHEN event_type = 'click' THEN NULL WHEN value > 150e0 THEN event_id % 64 + 41 "
                  "ELSE event_id % 64 + 1 END AS INT)"}, None),
    # messy page poles: duplicates of (route_id, number), gaps, three pages
    "v_poles": ("lineitem", {
        "route_id": "l_orderkey", "number": "l_linenumber", "page": "CAST(l_suppkey % 3 + 1 AS INT)",
        "x": "CAST(l_partkey % 600 AS DOUBLE)", "y": "l_quantity * 8e0",
        "row_id": "l_partkey * 1000000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT)"}, None),
    # text items with raw layer names
    "v_items": ("lineitem", {
        "route_id": "l_orderkey", "item_id": "l_partkey * 1000000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT)",
        "page": "CAST(l_suppkey % 3 + 1 AS INT)",
        "layer": "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'DISTÂNCIA_POSTE' "
                 "WHEN l_returnflag = 'A' THEN 'Numero_Poste' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'poste' "
                 "WHEN l_returnflag = 'N' THEN 'Texto_3' WHEN l_linestatus = 'F' THEN 'Padrao' ELSE 'Moldura Inteligente' END",
        "str": "concat(CAST(l_linenumber AS VARCHAR(4)), '0-', CAST(CAST(l_quantity AS INT) AS VARCHAR(4)), '0  (U) ', "
               "CAST(l_partkey AS VARCHAR(8)))",
        "x": "CAST(l_partkey % 600 AS DOUBLE) + l_tax * 200e0", "y": "l_quantity * 8e0 + l_discount * 500e0",
        "width": "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax * 100e0 END"}, None),
    # numbered text markers of the messy routes
    "v_markers": ("lineitem", {
        "route_id": "l_orderkey", "mark_id": "l_partkey * 1000000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT)",
        "page": "CAST(l_suppkey % 3 + 1 AS INT)",
        "x": "CAST((l_partkey + l_linenumber * 7) % 600 AS DOUBLE)", "y": "l_quantity * 8e0 + l_tax * 100e0"}, None),
    # region catalogue: overlapping boxes, so that the smallest area matters
    "v_regions": ("nation", {
        "region_id": "n_nationkey", "name": "n_name",
        "min_lat": "-27.6e0 - n_nationkey * 4e-4 - 3e-3", "max_lat": "-27.6e0 - n_nationkey * 4e-4",
        "min_lon": "-48.64e0", "max_lon": "-48.60e0 + n_nationkey * 1e-4", "uploaded_at": "n_regionkey * 1000"}, None),
}
UNIONS = {"v_all_spans": ("v_spans", "v_jumps")}


def _projection_sql(name: str) -> str:
    table, columns, where = PROJECTIONS[name]
    body = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    return f"SELECT {body} FROM {table}" + (f" WHERE {where}" if where else "")


def with_views(sql: str) -> str:
    """Prefix DuckDB SQL with the views it names."""
    named = set(re.findall(r"\bv_[a-z_]+\b", sql))
    parts = {n for n in named if n in PROJECTIONS}
    joined = {n for n in named if n in UNIONS}
    for n in joined:
        parts.update(UNIONS[n])
    ctes = [f"{n} AS ({_projection_sql(n)})" for n in PROJECTIONS if n in parts]
    ctes += [f"{n} AS ({' UNION ALL '.join(f'SELECT * FROM {p}' for p in UNIONS[n])})" for n in UNIONS if n in joined]
    body = sql.strip()
    if not ctes:
        return body
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if head:
        return f"WITH {'RECURSIVE ' if head.group(1) else ''}" + ", ".join(ctes) + ", " + body[head.end():]
    return "WITH " + ", ".join(ctes) + " " + body


FACTOR = "spark.sql.sources.fileCompressionFactor"
ROWS_TO_FILE = "50"  # a row of a few small integers takes about 1 byte in a file and 40 to 80 in a hash table


class Views:
    """DataFrames of one scale-factor folder, by view name without the v_ prefix.

    Dense numbers compress so well that Spark would take a table of millions of rows, read or checkpointed, for one to
    broadcast. The session is told how much larger rows are than their file, unless it has a factor of its own; sides that
    turn out small when their shuffle is measured are still broadcast.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        if float(spark.conf.get(FACTOR)) == 1.0:
            spark.conf.set(FACTOR, ROWS_TO_FILE)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        table, columns, where = PROJECTIONS[name]
        base = self.table(table)
        if where:
            base = base.where(where)
        return base.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])

    def __getattr__(self, name: str) -> DataFrame:
        full = f"v_{name}"
        if full in UNIONS:
            first, second = UNIONS[full]
            return self.view(first).unionByName(self.view(second))
        if full in PROJECTIONS:
            return self.view(full)
        raise AttributeError(name)
