"""Planar geometry on Columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routekit.functions.geodesy import haversine_m

__all__ = ["gps_to_local", "local_to_gps", "gps_lateral_m", "gps_foot_on_chord", "gps_reflect", "gps_shrink_lateral",
           "affine_apply", "affine_compose", "rotate", "flip_y", "text_anchor", "dist2d", "point_segment",
           "chord_side", "gps_chord_side", "lateral_m", "foot_on_chord", "reflect_across", "shrink_lateral",
           "detail_to_overview", "trilaterate", "in_bbox"]

# Metres per degree of the local plane, side dead band.
METRES_PER_DEG_LON = 111320.0
METRES_PER_DEG_LAT = 110540.0
SIDE_DEAD_BAND_PT = 2.0
SIDE_DEAD_BAND_M = 0.15


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else (value if isinstance(value, Column) else F.lit(value))


def dist2d(x1, y1, x2, y2) -> Column:
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    return F.sqrt(dx * dx + dy * dy)


def affine_apply(m, x, y) -> Column:
    """Apply struct<a,b,c,d,e,f>: x' = a·x + c·y + e, y' = b·x + d·y + f."""
    m, x, y = _c(m), _c(x), _c(y)
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"),
                    (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def affine_compose(outer, inner) -> Column:
    """Matrix that applies `inner` first and `outer` second."""
    p, q = _c(outer), _c(inner)
    linear = {n: p[r] * q[s] + p[t] * q[u] for n, (r, s, t, u) in {
        "a": ("a", "a", "c", "b"), "b": ("b", "a", "d", "b"),
        "c": ("a", "c", "c", "d"), "d": ("b", "c", "d", "d")}.items()}
    shift = affine_apply(p, q["e"], q["f"])
    return F.struct(*[v.alias(k) for k, v in linear.items()], shift["x"].alias("e"), shift["y"].alias("f"))


def rotate(x, y, theta) -> Column:
    x, y, theta = _c(x), _c(y), _c(theta)
    return F.struct((F.cos(theta) * x + F.sin(theta) * y).alias("x"),
                    (F.cos(theta) * y - F.sin(theta) * x).alias("y"))


def flip_y(y, page_height) -> Column:
    return _c(page_height) - _c(y)


def text_anchor(x, width) -> Column:
    return _c(x) + F.coalesce(_c(width), F.lit(0.0)) / 2


def in_bbox(x, y, min_x, min_y, max_x, max_y) -> Column:
    return _c(x).between(_c(min_x), _c(max_x)) & _c(y).between(_c(min_y), _c(max_y))


def _along(px, py, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    return dx, dy, length2, (px - ax) * dx + (py - ay) * dy


def point_segment(px, py, ax, ay, bx, by) -> Column:
    """struct<d,x,y,t>: distance to a segment, its foot, and the clamped fraction along it."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy, length2, dot = _along(px, py, ax, ay, bx, by)
    t = F.when(length2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / length2)))
    fx, fy = ax + t * dx, ay + t * dy
    return F.struct(dist2d(px, py, fx, fy).alias("d"), fx.alias("x"), fy.alias("y"), t.alias("t"))


def _cross(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def chord_side(px, py, ax, ay, bx, by, dead_band=SIDE_DEAD_BAND_PT) -> Column:
    """-1, 0 or +1: side of the chord a→b; 0 inside the dead band."""
    value = _cross(px, py, ax, ay, bx, by)
    return F.when(F.abs(value) <= dead_band, 0).otherwise(F.signum(value).cast("int"))


def gps_to_local(lat, lon, lat_a, lon_a, lat_b, lon_b) -> Column:
    """struct<x,y> metres from point a, on the local plane of the chord a→b."""
    lat, lon, lat_a, lon_a, lat_b = map(_c, (lat, lon, lat_a, lon_a, lat_b))
    shrink = F.cos(F.radians((lat_a + lat_b) / 2))
    return F.struct(((lon - lon_a) * METRES_PER_DEG_LON * shrink).alias("x"),
                    ((lat - lat_a) * METRES_PER_DEG_LAT).alias("y"))


def local_to_gps(x, y, lat_a, lon_a, lat_b) -> Column:
    lat_a, lon_a, lat_b = map(_c, (lat_a, lon_a, lat_b))
    shrink = F.cos(F.radians((lat_a + lat_b) / 2))
    return F.struct((lat_a + _c(y) / METRES_PER_DEG_LAT).alias("lat"),
                    (lon_a + _c(x) / (METRES_PER_DEG_LON * shrink)).alias("lon"))


def _gps_chord(lat, lon, lat_a, lon_a, lat_b, lon_b):
    b = gps_to_local(lat_b, lon_b, lat_a, lon_a, lat_b, lon_b)
    p = gps_to_local(lat, lon, lat_a, lon_a, lat_b, lon_b)
    return b["x"], b["y"], p["x"], p["y"]


def gps_chord_side(lat, lon, lat_a, lon_a, lat_b, lon_b, dead_band=SIDE_DEAD_BAND_M) -> Column:
    bx, by, px, py = _gps_chord(lat, lon, lat_a, lon_a, lat_b, lon_b)
    return chord_side(px, py, 0.0, 0.0, bx, by, dead_band)


def gps_lateral_m(lat, lon, lat_a, lon_a, lat_b, lon_b) -> Column:
    """Metres from the infinite chord; 0 for a chord shorter than 10 cm."""
    bx, by, px, py = _gps_chord(lat, lon, lat_a, lon_a, lat_b, lon_b)
    return F.when(bx * bx + by * by < 0.01, 0.0).otherwise(lateral_m(px, py, 0.0, 0.0, bx, by))


def gps_foot_on_chord(lat, lon, lat_a, lon_a, lat_b, lon_b) -> Column:
    """struct<lat,lon>: nearest point of the chord segment."""
    bx, by, px, py = _gps_chord(lat, lon, lat_a, lon_a, lat_b, lon_b)
    foot = point_segment(px, py, 0.0, 0.0, bx, by)
    here = F.struct(_c(lat).alias("lat"), _c(lon).alias("lon"))
    return F.when(bx * bx + by * by < 0.01, here).otherwise(local_to_gps(foot["x"], foot["y"], lat_a, lon_a, lat_b))


def gps_reflect(lat, lon, lat_a, lon_a, lat_b, lon_b) -> Column:
    """struct<lat,lon>: mirror image across the infinite chord."""
    bx, by, px, py = _gps_chord(lat, lon, lat_a, lon_a, lat_b, lon_b)
    image = reflect_across(px, py, 0.0, 0.0, bx, by)
    here = F.struct(_c(lat).alias("lat"), _c(lon).alias("lon"))
    return F.when(bx * bx + by * by < 0.01, here).otherwise(local_to_gps(image["x"], image["y"], lat_a, lon_a, lat_b))


def lateral_m(px, py, ax, ay, bx, by) -> Column:
    """Perpendicular distance to the infinite chord (to `a` for an empty chord)."""
    span = dist2d(ax, ay, bx, by)
    return F.when(span < 1e-9, dist2d(px, py, ax, ay)).otherwise(F.abs(_cross(px, py, ax, ay, bx, by)) / span)


def foot_on_chord(px, py, ax, ay, bx, by) -> Column:
    """struct<x,y,t> of the perpendicular foot on the infinite chord."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy, length2, dot = _along(px, py, ax, ay, bx, by)
    t = F.when(length2 == 0, F.lit(0.0)).otherwise(dot / length2)
    return F.struct((ax + t * dx).alias("x"), (ay + t * dy).alias("y"), t.alias("t"))


def reflect_across(px, py, ax, ay, bx, by) -> Column:
    foot = foot_on_chord(px, py, ax, ay, bx, by)
    return F.struct((2 * foot["x"] - _c(px)).alias("x"), (2 * foot["y"] - _c(py)).alias("y"))


def shrink_lateral(px, py, fx, fy, max_m) -> Column:
    """Pull a point toward its foot until it is at most max_m away."""
    px, py, fx, fy, max_m = map(_c, (px, py, fx, fy, max_m))
    d = dist2d(fx, fy, px, py)
    k = F.when(d > max_m, max_m / d).otherwise(F.lit(1.0))
    return F.struct((fx + k * (px - fx)).alias("x"), (fy + k * (py - fy)).alias("y"))


def gps_shrink_lateral(lat, lon, foot_lat, foot_lon, max_m) -> Column:
    """struct<lat,lon>: pull a position toward its foot until it is at most max_m away."""
    lat, lon, foot_lat, foot_lon, max_m = map(_c, (lat, lon, foot_lat, foot_lon, max_m))
    d = haversine_m(foot_lat, foot_lon, lat, lon)
    k = F.when(d > max_m, max_m / d).otherwise(F.lit(1.0))
    return F.struct((foot_lat + k * (lat - foot_lat)).alias("lat"), (foot_lon + k * (lon - foot_lon)).alias("lon"))


def detail_to_overview(x, y, box, page_w, scale_detail, scale_overview) -> Column:
    """Map a detail-page point into its overview box, preserving ground distance when both scales are known."""
    x, y, box, sd, so = _c(x), _c(y), _c(box), _c(scale_detail), _c(scale_overview)
    k = F.when((so > 0) & (sd > 0), sd / so).otherwise(box["w"] / _c(page_w))
    return F.struct((box["x"] + x * k).alias("x"), (box["y"] + y * k).alias("y"))


def trilaterate(ax, ay, r1, bx, by, r2, ex, ey) -> Column:
    """struct<x,y>: meeting point of two circles nearest the estimate.

    Circles that do not cross fall back to a point of the centre line; coincident centres step east by r1.
    """
    ax, ay, r1, bx, by, r2, ex, ey = map(_c, (ax, ay, r1, bx, by, r2, ex, ey))
    d = dist2d(ax, ay, bx, by)
    far, nested = d >= r1 + r2, d <= F.abs(r1 - r2)
    along = F.when(far, d * r1 / (r1 + r2)).when(nested, r1).otherwise((d * d + r1 * r1 - r2 * r2) / (2 * d))
    rise = F.when(far | nested, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), r1 * r1 - along * along)))
    ux, uy = (bx - ax) / d, (by - ay) / d
    side = F.when(ux * (ey - ay) - uy * (ex - ax) >= 0, 1.0).otherwise(-1.0)
    x = F.when(d < 1e-9, ax + r1).otherwise(ax + along * ux - side * rise * uy)
    y = F.when(d < 1e-9, ay).otherwise(ay + along * uy + side * rise * ux)
    return F.struct(x.alias("x"), y.alias("y"))
