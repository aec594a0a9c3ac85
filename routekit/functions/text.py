"""Text parsing and formatting on Columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["parse_metres", "pole_type", "digits", "parse_coordinate", "xml_escape", "pad_number", "kml_color",
           "sanitize_id", "style_options", "PRESET_COLORS", "STYLE_DEFAULTS"]

# Colour presets and document style defaults.
PRESET_COLORS = {"red": "#ff0000", "green": "#00ff00", "blue": "#0000ff", "white": "#ffffff", "yellow": "#ffff00",
                 "black": "#000000", "amber": "#ffaa00", "aqua": "#55ffff", "moss": "#55aa00"}
STYLE_DEFAULTS = {"iconHref": "http://maps.google.com/mapfiles/kml/shapes/placemark_square.png",
                  "iconColor": "green", "lineColor": "red", "lineWidth": "3", "labelColor": "white",
                  "labelScale": "1", "lineDescription": ""}
# Fixed value: a pole's type, as height and strength (`11-400`) with an optional remark in brackets.
POLE_TYPE = r"\b\d{1,3}\s*-\s*\d{1,4}\b(?:\s*\([^)]{0,24}\))?"


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_metres(text) -> Column:
    """Printed metres with a decimal comma; null unless a strict positive number."""
    clean = F.replace(F.regexp_replace(_c(text), r"\s+", ""), F.lit(","), F.lit("."))
    value = F.when(clean.rlike(r"^\d+(\.\d+)?$"), clean.try_cast("double"))
    return F.when(value > 0, value)


def pole_type(text) -> Column:
    hit = F.regexp_extract(_c(text), POLE_TYPE, 0)
    return F.nullif(F.trim(F.regexp_replace(hit, r"\s+", " ")), F.lit(""))


def digits(text) -> Column:
    """Longest run of one to three digits (the first of equal length), as int."""
    runs = F.regexp_extract_all(_c(text), F.lit(r"(\d{1,3})"), 1)
    longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
    return F.try_element_at(F.filter(runs, lambda r: F.length(r) == longest), F.lit(1)).cast("int")


def parse_coordinate(text) -> Column:
    """struct<lat,lon> of a pasted pair, or null when malformed or out of range."""
    raw = F.trim(_c(text))
    number = r"(-?\d+(?:\.\d+)?)"
    pattern = F.when(F.contains(raw, F.lit(",")), F.lit(rf"^{number}\s*,\s*{number}$")) \
        .otherwise(F.lit(rf"^{number}\s+{number}$"))
    part = lambda i: F.nullif(F.regexp_extract(raw, rf"^{number}(?:\s*,\s*|\s+){number}$", i), F.lit("")) \
        .try_cast("double")
    lat, lon = part(1), part(2)
    ok = F.regexp_like(raw, pattern) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def xml_escape(text) -> Column:
    out = _c(text).cast("string")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def pad_number(number) -> Column:
    text = _c(number).cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def kml_color(hex_rgb, alpha=255) -> Column:
    """aabbggrr from #RRGGBB; null for anything else."""
    raw = F.regexp_replace(F.trim(_c(hex_rgb)), "^#", "")
    byte = lambda start: F.substring(raw, start, 2)
    alpha = max(0, min(255, int(alpha)))
    return F.when(raw.rlike("^[0-9a-fA-F]{6}$"), F.lower(F.concat(F.lit(f"{alpha:02x}"), byte(5), byte(3), byte(1))))


def sanitize_id(text) -> Column:
    clean = F.substring(F.regexp_replace(F.trim(F.coalesce(_c(text).cast("string"), F.lit(""))),
                                         r"[^a-zA-Z0-9._-]", "_"), 1, 120)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("region"))


def style_options(options) -> Column:
    """Per-document option map laid over the defaults, with resolved KML colours added."""
    as_map = lambda d: F.create_map(*[F.lit(p) for kv in d.items() for p in kv])
    merged = F.map_concat(
        F.map_filter(as_map(STYLE_DEFAULTS), lambda k, _: ~F.coalesce(F.map_contains_key(_c(options), k), F.lit(False))),
        F.coalesce(_c(options), F.create_map().cast("map<string,string>")))
    presets = as_map(PRESET_COLORS)

    def resolved(name):
        return kml_color(F.coalesce(presets[merged[name]], F.lit(PRESET_COLORS[STYLE_DEFAULTS[name]])))

    return F.map_concat(merged, F.create_map(
        F.lit("iconColorKml"), resolved("iconColor"), F.lit("lineColorKml"), resolved("lineColor"),
        F.lit("labelColorKml"), resolved("labelColor")))
