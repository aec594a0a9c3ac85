"""Domain rules: tolerances, costs, tiers, source authority, number repairs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["span_tolerance", "edge_cost", "accuracy_tier", "source_rank", "is_invented", "is_authoritative",
           "ratio_penalty", "degree_class", "is_truncated", "nineties_candidates", "mirror_number",
           "has_gps", "has_active_metres", "is_blocked", "SOURCE_RANK", "INVENTED_SOURCES",
           "AUTHORITATIVE_SOURCES", "BLOCKING_SOURCES", "MAIN_SOURCES"]

# Span sources by authority, and the source classes.
SOURCE_RANK = {"override": 4, "bifurcation-main": 3, "bifurcation-tap": 3, "branch-arm-rehomed": 3,
               "inferred-label": 2, "legacy-midpoint": 1}
INVENTED_SOURCES = ["jumpback-refill", "inferred-label", "window-refine-duplicate"]
AUTHORITATIVE_SOURCES = ["bifurcation-main", "branch-arm-rehomed", "branch-arm-rehomed-cross-page",
                         "branch-arm-rehomed-topology", "override"]
BLOCKING_SOURCES = ["jumpback-suppressed", "bifurcation-cleared"]
MAIN_SOURCES = ["bifurcation-main", "inferred-label"]
# Readings that lost or changed a digit, as bounds of the reading, of the expected number and of their gap,
# and whether the expected number must end in the reading.
TRUNCATIONS = [
    {"reading": (None, 9), "expected": (50, None), "gap": (None, None), "ends": True},
    {"reading": (35, 45), "expected": (65, None), "gap": (30, 30), "ends": False},
    {"reading": (25, 35), "expected": (45, None), "gap": (20, 20), "ends": False},
    {"reading": (None, 9), "expected": (50, None), "gap": (50, None), "ends": False},
]
# Two-digit readings with a misread first digit, and what to subtract, preferred first.
NINETIES, NINETIES_LESS = (86, 99), (40, 38)


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else (value if isinstance(value, Column) else F.lit(value))


def span_tolerance(label, floor_m=2.0, ceil_m=10.0, fraction=0.15) -> Column:
    return F.least(F.lit(ceil_m), F.greatest(F.lit(floor_m), fraction * _c(label)))


def edge_cost(span, printed, invented) -> Column:
    """Misfit beyond a dead band of max(0.5 m, 5 %); half weight for invented labels; 0 when nothing is printed."""
    over = F.greatest(F.lit(0.0), F.abs(_c(span) - _c(printed)) - F.greatest(F.lit(0.5), 0.05 * _c(printed)))
    return F.coalesce(F.when(_c(invented), 0.5 * over).otherwise(over), F.lit(0.0))


def accuracy_tier(error_m) -> Column:
    e = _c(error_m)
    return (F.when(e <= 5, "perfect").when(e <= 10, "good").when(e <= 15, "acceptable")
            .when(e.isNotNull(), "bad"))


def source_rank(source) -> Column:
    pairs = [F.lit(part) for item in SOURCE_RANK.items() for part in item]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(_c(source), F.lit(""))], F.lit(0))


def is_invented(source) -> Column:
    return F.coalesce(_c(source).isin(INVENTED_SOURCES), F.lit(False))


def is_authoritative(source) -> Column:
    return F.coalesce(_c(source).isin(AUTHORITATIVE_SOURCES), F.lit(False))


def ratio_penalty(points, scale, metres, low=0.35, high=2.5, weight=35.0) -> Column:
    """struct<penalty,plausible> for drawn-versus-printed length; zero penalty when no scale is known."""
    ratio = F.when((_c(metres) > 0) & (_c(points) > 0), _c(points) * _c(scale) / _c(metres))
    return F.struct(F.coalesce(weight * F.abs(F.ln(ratio)), F.lit(0.0)).alias("penalty"),
                    F.coalesce(ratio.between(low, high), F.lit(True)).alias("plausible"))


def degree_class(degree) -> Column:
    return F.when(_c(degree) <= 1, 1).when(_c(degree) == 2, 2).otherwise(3)


def is_truncated(number, expected) -> Column:
    """A short or slipped reading of the expected number."""
    n, e = _c(number), _c(expected)
    value = {"reading": n, "expected": e, "gap": e - n}
    hit = F.lit(False)
    for case in TRUNCATIONS:
        fits = F.endswith(e.cast("string"), n.cast("string")) if case["ends"] else F.lit(True)
        for name, what in value.items():
            low, high = case[name]
            fits = fits & (what >= low if low is not None else F.lit(True)) & (what <= high if high is not None else F.lit(True))
        hit = hit | fits
    return F.coalesce((n != e) & hit, F.lit(False))


def nineties_candidates(number, max_number) -> Column:
    """array<int>: repairs for a reading in NINETIES, preferred first."""
    n = _c(number)
    both = F.array(*(n - less for less in NINETIES_LESS))
    kept = F.filter(both, lambda c: (c >= 1) & (c <= _c(max_number)))
    return F.when(n.between(*NINETIES), kept).otherwise(F.array().cast("array<int>"))


def mirror_number(number, low, high) -> Column:
    return _c(low) + _c(high) - _c(number)


def has_gps(lat, lon) -> Column:
    return _c(lat).isNotNull() & _c(lon).isNotNull()


def has_active_metres(metres) -> Column:
    return F.coalesce(_c(metres) > 0, F.lit(False))


def is_blocked(metres, source) -> Column:
    return _c(metres).isNull() & F.coalesce(_c(source).isin(BLOCKING_SOURCES), F.lit(False))
