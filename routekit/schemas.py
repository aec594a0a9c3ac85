"""Explicit schemas of the route-survey tables."""
from pyspark.sql import types as T


def _schema(**fields):
    kinds = {"l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "s": T.StringType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k] if isinstance(k, str) else k) for n, k in fields.items()])


POLES = _schema(route_id="l", number="i", page="i", x="d", y="d", anchor_x="d", anchor_y="d", pole_type="s", lat="d", lon="d", source="s")
TEXT_ITEMS = _schema(route_id="l", item_id="l", page="i", layer="s", str="s", x="d", y="d", width="d")
READINGS = _schema(route_id="l", page="i", x="d", y="d", number="i")
PATH_OPS = _schema(route_id="l", page="i", path_id="l", seq="i", op="s", x="d", y="d", x1="d", y1="d", x2="d", y2="d")
SPANS = _schema(route_id="l", lo="i", hi="i", meters="d", source="s")
CONNECTIONS = _schema(route_id="l", src="i", dst="i", meters="d", bearing="d", gap="b", cross_page="b", source="s")
REGIONS = _schema(region_id="l", name="s", uploaded_at="l", min_lat="d", max_lat="d", min_lon="d", max_lon="d")
REGION_POLES = _schema(region_id="l", idx="l", x="d", y="d", block="s")
REGION_EDGES = _schema(region_id="l", edge_id="l", poly="l", kind="s", ax="d", ay="d", bx="d", by="d")
TRUTH = _schema(route_id="l", number="i", lat="d", lon="d")
