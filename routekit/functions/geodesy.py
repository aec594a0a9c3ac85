"""Geodesy as pure Column arithmetic: UTM series, great-circle distance, bearings."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["utm_zone", "utm_forward", "utm_inverse", "haversine_m", "bearing_deg", "flip_bearing",
           "page_bearing", "destination", "in_country", "in_zone_envelope", "utm_in_country",
           "page_to_utm", "utm_to_page", "page_to_gps", "in_warn_bounds", "COUNTRY_BOX", "WARN_BOX", "ZONE_BOX"]

# WGS-84 ellipsoid, UTM scale and false origins, spherical earth radius.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0
EARTH_RADIUS = 6371000.0
WARN_BOX = {"min_lat": -34.0, "max_lat": 5.0, "min_lon": -74.0, "max_lon": -35.0}
COUNTRY_BOX = {"min_lat": -33.8, "max_lat": 5.3, "min_lon": -73.0, "max_lon": -34.8}
ZONE_BOX = {"min_e": 600000.0, "max_e": 800000.0, "min_n": 6700000.0, "max_n": 7100000.0}

_MINOR = SEMI_MAJOR * (1 - FLATTENING)
_ECC2 = 1 - (_MINOR * _MINOR) / (SEMI_MAJOR * SEMI_MAJOR)
_ECC2P = _ECC2 / (1 - _ECC2)


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else (value if isinstance(value, Column) else F.lit(value))


def _horner(variable: Column, coefficients) -> Column:
    """Polynomial with the lowest-order coefficient first."""
    total = F.lit(float(coefficients[-1]))
    for coefficient in reversed(coefficients[:-1]):
        total = total * variable + F.lit(float(coefficient))
    return total


def utm_zone(lon) -> Column:
    return (F.floor((_c(lon) + 180) / 6) + 1).cast("int")


def _central_meridian(zone: Column) -> Column:
    return F.radians((zone - 1) * 6 - 177)


def utm_forward(lat, lon) -> Column:
    """struct<easting,northing,zone> on the southern transverse Mercator grid."""
    lat, lon = _c(lat), _c(lon)
    zone = utm_zone(lon)
    phi = F.radians(lat)
    sin_phi, cos_phi, tan_phi = F.sin(phi), F.cos(phi), F.tan(phi)
    prime = SEMI_MAJOR / F.sqrt(1 - _ECC2 * sin_phi * sin_phi)
    t = tan_phi * tan_phi
    c = _ECC2P * cos_phi * cos_phi
    a = cos_phi * (F.radians(lon) - _central_meridian(zone))
    a2 = a * a
    e4, e6 = _ECC2 ** 2, _ECC2 ** 3
    arc = SEMI_MAJOR * ((1 - _ECC2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
                        - (3 * _ECC2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
                        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
                        - (35 * e6 / 3072) * F.sin(6 * phi))
    odd3 = (1 - t + c) / 6
    odd5 = (5 - 18 * t + t * t + 72 * c - 58 * _ECC2P) / 120
    even4 = (5 - t + 9 * c + 4 * c * c) / 24
    even6 = (61 - 58 * t + t * t + 600 * c - 330 * _ECC2P) / 720
    easting = FALSE_EASTING + UTM_SCALE * prime * a * (1 + a2 * (odd3 + a2 * odd5))
    northing = FALSE_NORTHING_SOUTH + UTM_SCALE * (
        arc + prime * tan_phi * a2 * (F.lit(0.5) + a2 * (even4 + a2 * even6)))
    return F.struct(easting.alias("easting"), northing.alias("northing"), zone.alias("zone"))


def utm_inverse(easting, northing, zone) -> Column:
    """struct<lat,lon> in degrees from southern UTM metres."""
    x = _c(easting) - FALSE_EASTING
    meridian_arc = (_c(northing) - FALSE_NORTHING_SOUTH) / UTM_SCALE
    e4, e6 = _ECC2 ** 2, _ECC2 ** 3
    ratio = math.sqrt(1 - _ECC2)
    e1 = (1 - ratio) / (1 + ratio)
    mu = meridian_arc / (SEMI_MAJOR * (1 - _ECC2 / 4 - 3 * e4 / 64 - 5 * e6 / 256))
    foot = (mu + (3 * e1 / 2 - 27 * e1 ** 3 / 32) * F.sin(2 * mu)
            + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * F.sin(4 * mu)
            + (151 * e1 ** 3 / 96) * F.sin(6 * mu)
            + (1097 * e1 ** 4 / 512) * F.sin(8 * mu))
    sin_f, cos_f, tan_f = F.sin(foot), F.cos(foot), F.tan(foot)
    w = 1 - _ECC2 * sin_f * sin_f
    n1 = SEMI_MAJOR / F.sqrt(w)
    r1 = SEMI_MAJOR * (1 - _ECC2) / F.pow(w, F.lit(1.5))
    t1 = tan_f * tan_f
    c1 = _ECC2P * cos_f * cos_f
    d = x / (n1 * UTM_SCALE)
    d2 = d * d
    lat = foot - (n1 * tan_f / r1) * d2 * (
        F.lit(0.5) - d2 * (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * _ECC2P) / 24)
    lon = _central_meridian(_c(zone)) + d * (1 - d2 * (1 + 2 * t1 + c1) / 6) / cos_f
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial great-circle bearing, 0..360, clockwise from north."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    phi1, phi2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(phi2)
    north = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def page_bearing(x1, y1, x2, y2) -> Column:
    """Bearing of a page displacement: 0 along +y, 90 along +x."""
    return F.pmod(F.degrees(F.atan2(_c(x2) - _c(x1), _c(y2) - _c(y1))) + 360, F.lit(360.0))


def flip_bearing(bearing) -> Column:
    return F.pmod(_c(bearing) + 180, F.lit(360.0))


def destination(lat, lon, bearing, metres) -> Column:
    """struct<lat,lon> reached from a start point along a bearing."""
    phi, brg, ang = F.radians(_c(lat)), F.radians(_c(bearing)), _c(metres) / EARTH_RADIUS
    sin_end = F.sin(phi) * F.cos(ang) + F.cos(phi) * F.sin(ang) * F.cos(brg)
    end = F.asin(sin_end)
    turn = F.atan2(F.sin(brg) * F.sin(ang) * F.cos(phi), F.cos(ang) - F.sin(phi) * F.sin(end))
    return F.struct(F.degrees(end).alias("lat"), F.degrees(F.radians(_c(lon)) + turn).alias("lon"))


def _in_box(lat, lon, box) -> Column:
    return _c(lat).between(box["min_lat"], box["max_lat"]) & _c(lon).between(box["min_lon"], box["max_lon"])


def in_country(lat, lon) -> Column:
    return _in_box(lat, lon, COUNTRY_BOX)


def in_warn_bounds(lat, lon) -> Column:
    """The looser box that only warns about a pasted coordinate."""
    return _in_box(lat, lon, WARN_BOX)


def in_zone_envelope(easting, northing) -> Column:
    return (_c(easting).between(ZONE_BOX["min_e"], ZONE_BOX["max_e"])
            & _c(northing).between(ZONE_BOX["min_n"], ZONE_BOX["max_n"]))


def utm_in_country(easting, northing, zone) -> Column:
    point = utm_inverse(easting, northing, zone)
    return in_country(point["lat"], point["lon"])


def page_to_utm(x, y, origin_e, origin_n, sx, sy, theta=0.0, affine=None) -> Column:
    """struct<easting,northing>; `affine` is a nullable struct<m00,m01,m10,m11> that wins over the scales."""
    x, y, theta = _c(x), _c(y), F.coalesce(_c(theta), F.lit(0.0))
    rx = F.cos(theta) * x + F.sin(theta) * y
    ry = F.cos(theta) * y - F.sin(theta) * x
    east, north = _c(origin_e) + rx * _c(sx), _c(origin_n) - ry * _c(sy)
    if affine is not None:
        m = _c(affine)
        east = F.when(m.isNull(), east).otherwise(_c(origin_e) + m["m00"] * x - m["m01"] * y)
        north = F.when(m.isNull(), north).otherwise(_c(origin_n) + m["m10"] * x - m["m11"] * y)
    return F.struct(east.alias("easting"), north.alias("northing"))


def utm_to_page(easting, northing, origin_e, origin_n, sx, sy, theta=0.0) -> Column:
    """struct<x,y>: inverse of page_to_utm for scaled and rotated pages; null for zero scales."""
    theta = F.coalesce(_c(theta), F.lit(0.0))
    rx = (_c(easting) - _c(origin_e)) / F.nullif(_c(sx), F.lit(0.0))
    ry = (_c(origin_n) - _c(northing)) / F.nullif(_c(sy), F.lit(0.0))
    x = F.cos(theta) * rx - F.sin(theta) * ry
    y = F.sin(theta) * rx + F.cos(theta) * ry
    return F.struct(x.alias("x"), y.alias("y"))


def page_to_gps(x, y, origin_e, origin_n, sx, sy, zone, theta=0.0, affine=None) -> Column:
    grid = page_to_utm(x, y, origin_e, origin_n, sx, sy, theta, affine)
    return utm_inverse(grid["easting"], grid["northing"], zone)
