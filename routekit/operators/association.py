"""Printed span labels: assignment to spans, de-duplication and repair of the label graph."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routekit.functions import (BLOCKING_SOURCES, dist2d, has_active_metres, is_blocked, parse_metres, point_segment,
                                ratio_penalty, source_rank, text_anchor)
from routekit.operators.core import checkpoint, chunked_fold, greedy_pairs, number_chunk, ordered_scan
from routekit.operators.matching import near_segments, nearest_poles
from routekit.operators.sequence import consecutive

PAGE = ["route_id", "page"]
EDGE = ["route_id", "lo", "hi"]
# Scores in page points, label tolerances in metres.
SCORE_CAP, ON_CHORD_PT, MONOTONIC_GAP_PT, LOOKAHEAD, ORDER_WEIGHT = 120.0, 55.0, 90.0, 5, 10.0
INFER_GAP_PT, INFER_SCORE, INFER_SPAN = 30.0, 80.0, 6
SAME_LABEL_M, EXACT_LABEL_M = 0.25, 0.05
SWAP_ON_CHORD_PT, SWAP_GAIN_PT, SWAP_MIN_M = 45.0, 12.0, 0.5
SPLIT_RATIO, SPLIT_GAP_PT, SPLIT_SUM_TOL = 1.35, 60.0, 0.2
ORPHAN_GAP_PT, ORPHAN_FACTOR = 52.0, 0.88
ARM_NEAR_PT, ARM_BEARING_DEG, ARM_ON_CABLE_PT, ARM_GAP_PT, ARM_GAIN_PT = 150.0, 12.0, 14.0, 30.0, 8.0


def label_points(labels: DataFrame) -> DataFrame:
    """Labels with a printed length: route_id, page, item_id, metres, x, y at the text centre."""
    return (labels.withColumns({"metres": parse_metres("str"), "_ax": text_anchor("x", "width")}).where("metres IS NOT NULL")
            .select(*PAGE, "item_id", "metres", F.col("_ax").alias("x"), "y"))


def span_segments(poles: DataFrame) -> DataFrame:
    """Spans between consecutive poles as page segments. A page-crossing span is its incoming pole on the incoming page.

    Columns: route_id, page, seg_id (lo), hi, cross, ax, ay, bx, by, drawn.
    """
    linked = consecutive(poles).where("next_number IS NOT NULL")
    cross = F.col("page") != F.col("next_page")
    return linked.select("route_id", F.col("next_page").alias("page"), F.col("number").alias("seg_id"), F.col("next_number").alias("hi"), cross.alias("cross"),
                         F.when(cross, F.col("next_x")).otherwise(F.col("x")).alias("ax"), F.when(cross, F.col("next_y")).otherwise(F.col("y")).alias("ay"),
                         F.col("next_x").alias("bx"), F.col("next_y").alias("by"), dist2d("x", "y", "next_x", "next_y").alias("drawn"))


def span_candidates(segments: DataFrame, points: DataFrame, scales: DataFrame, cap: float = SCORE_CAP, max_gap: float | None = None) -> DataFrame:
    """Scored (span, label) pairs: gap plus the drawn/printed ratio penalty, up to the cap.

    Adds lid (span's lower number), rid (label), cost, metres, gap, t.
    """
    met = near_segments(points.withColumnRenamed("item_id", "point_id"), segments, max_gap or cap)
    rows = (met.join(segments.select(*PAGE, "seg_id", "hi", "cross", "drawn"), [*PAGE, "seg_id"])
            .join(points.select(*PAGE, F.col("item_id").alias("point_id"), "metres"), [*PAGE, "point_id"]).join(scales.select(*PAGE, "scale"), PAGE, "left"))
    fit = ratio_penalty("drawn", F.when(~F.col("cross"), F.col("scale")), "metres")
    rows = rows.withColumn("_f", fit).where(F.col("_f.plausible") | (F.col("d") < ON_CHORD_PT))
    cost = F.col("d") + F.col("_f.penalty")
    return rows.select("route_id", F.col("seg_id").alias("lid"), F.col("point_id").alias("rid"), cost.alias("cost"), "hi", "metres", F.col("d").alias("gap"), "t").where(F.col("cost") <= cap)


def assign_labels_to_spans(poles: DataFrame, labels: DataFrame, scales: DataFrame, cap: float = SCORE_CAP) -> DataFrame:
    """Label per consecutive span, best score first, one to one: route_id, lo, hi, meters, item_id, source."""
    segments = span_segments(poles)
    won = greedy_pairs(span_candidates(segments, label_points(labels), scales, cap), ["route_id"])
    got = won.select("route_id", F.col("lid").alias("lo"), F.col("metres").alias("meters"), F.col("rid").alias("item_id"))
    spans = segments.select("route_id", F.col("seg_id").alias("lo"), "hi")
    return spans.join(got, ["route_id", "lo"], "left").withColumn("source", F.when(F.col("meters").isNotNull(), "legacy-midpoint"))


def infer_nonconsecutive(poles: DataFrame, labels: DataFrame, scales: DataFrame, k: int = 4) -> DataFrame:
    """Spans between non-consecutive poles, from labels that lie on the chord of two of their k nearest poles.

    Result: route_id, lo, hi, meters, item_id, source. At most k·(k-1)/2 chords are tried per label.
    """
    points = label_points(labels)
    ranked = ordered_scan(poles.select(*PAGE, "number", "x", "y"), "route_id", "number", chunk=number_chunk(), cumsum={"idx": F.lit(1)})
    near = nearest_poles(points, poles, k).join(ranked.select("route_id", "number", "x", "y", "idx"), ["route_id", "number"])
    near = near.groupBy(*PAGE, "item_id").agg(F.collect_list(F.struct("number", "x", "y", "idx")).alias("_p"))  # k entries
    each = near.withColumn("a", F.explode("_p")).withColumn("b", F.explode("_p")).where("a.number < b.number").join(points, [*PAGE, "item_id"])
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    drawn2 = dx * dx + dy * dy
    t = ((F.col("x") - F.col("a.x")) * dx + (F.col("y") - F.col("a.y")) * dy) / drawn2
    fit = ratio_penalty(F.sqrt(drawn2), "scale", "metres", 0.5, 2.0)
    scored = (each.join(scales.select(*PAGE, "scale"), PAGE, "left").where(drawn2 >= 1e-6).where(t.between(0.1, 0.9))
              .withColumn("_gap", point_segment("x", "y", "a.x", "a.y", "b.x", "b.y")["d"]).where(F.col("_gap") <= INFER_GAP_PT).withColumn("_f", fit))
    scored = scored.where("_f.plausible").withColumn("_score", F.col("_gap") + F.col("_f.penalty")).where(F.col("_score") <= INFER_SCORE)
    best = scored.groupBy("route_id", "item_id").agg(F.min(F.struct("_score", "a.number", F.col("b.number").alias("to"), (F.col("b.idx") - F.col("a.idx")).alias("span"), "metres")).alias("_b"))
    edges = best.select("route_id", "item_id", F.col("_b.number").alias("lo"), F.col("_b.to").alias("hi"), F.col("_b.span").alias("span"), F.col("_b.metres").alias("meters"))
    kept = edges.where((F.col("span") > 1) & (F.col("span") <= INFER_SPAN))
    return (kept.groupBy(*EDGE).agg(F.min(F.struct("meters", "item_id")).alias("_m"))
            .select(*EDGE, "_m.meters", "_m.item_id", F.lit("inferred-label").alias("source")))


def associate(poles: DataFrame, labels: DataFrame, scales: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The whole association: inferred chords claim labels first, consecutive spans take the rest, then merge."""
    inferred = checkpoint(infer_nonconsecutive(poles, labels, scales))
    rest = labels.join(inferred.select("route_id", "item_id"), ["route_id", "item_id"], "left_anti")
    return merge_spans(assign_labels_to_spans(poles, rest, scales), inferred, overrides)


def merge_spans(seq: DataFrame, inferred: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Consecutive spans plus the inferred pairs they lack; overrides (route_id, lo, hi, meters) win last, a zero too."""
    columns = [*EDGE, "meters", "source"]
    extra = inferred.join(seq.select(*EDGE), EDGE, "left_anti")
    merged = seq.select(*columns).unionByName(extra.select(*columns))
    if overrides is None:
        return merged
    by_hand = overrides.where("meters IS NOT NULL").select(*EDGE, F.col("meters").alias("_o"))
    return merged.join(by_hand, EDGE, "left").select(*EDGE, F.coalesce("_o", "meters").alias("meters"), F.when(F.col("_o").isNotNull(), "override").otherwise(F.col("source")).alias("source"))


def undirected_spans(spans: DataFrame) -> DataFrame:
    """One row per pair with lo < hi: the most authoritative source, then the largest length."""
    turned = spans.select("route_id", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"), "meters", "source")
    best = F.max_by(F.struct("meters", "source"), F.struct(source_rank("source"), F.col("meters").isNotNull(), "meters", "source"))
    return turned.groupBy(*EDGE).agg(best.alias("_b")).select(*EDGE, "_b.*")


def outgoing(conns: DataFrame) -> DataFrame:
    """Sorted neighbour list per pole: route_id, src, dsts."""
    return conns.groupBy("route_id", "src").agg(F.array_sort(F.collect_set("dst")).alias("dsts"))


# ---------------------------------------------------------------- order along the street

def street_order_remap(spans: DataFrame, labels: DataFrame, poles: DataFrame) -> DataFrame:
    """Re-attach a run's labels in street order where that strictly lowers the summed gap.

    spans: assign_labels_to_spans output. A run is a maximal chain of labelled same-page spans. Result: route_id, lo,
    hi, meters, item_id, remapped.
    """
    points, segments = label_points(labels), span_segments(poles)
    used = segments.where("NOT cross").select("route_id", "page", F.col("seg_id").alias("lo"), "hi", "ax", "ay", "bx", "by", "drawn") \
        .join(spans.where("item_id IS NOT NULL").select("route_id", "lo", "item_id"), ["route_id", "lo"])
    seen = ordered_scan(used, PAGE, "lo", chunk=number_chunk("lo"), lag={"_ph": "hi"})
    opens = F.when(F.col("_ph").isNull() | (F.col("_ph") != F.col("lo")), F.col("lo"))
    runs = ordered_scan(seen.withColumn("_open", opens), PAGE, "lo", chunk=number_chunk("lo"), cummax={"run": "_open"})
    key = [*PAGE, "run"]
    runs = ordered_scan(runs, key, "lo", chunk=number_chunk("lo"), cumsum={"_cum": "drawn", "k": F.lit(1)})
    runs = checkpoint(runs.withColumn("_c0", F.col("_cum") - F.col("drawn")).drop("_ph", "_open", "_cum"))
    spots = runs.select(*key, "item_id", "lo", "k").join(points.select(*PAGE, "item_id", "x", "y", "metres"), [*PAGE, "item_id"])
    segs = runs.select(*key, F.col("lo").alias("seg_id"), "ax", "ay", "bx", "by", F.col("_c0").alias("c0"), "drawn")
    asked = spots.select(*key, F.col("item_id").alias("point_id"), "x", "y")
    reach = near_segments(asked, segs, SCORE_CAP, by=key)  # a label lies within the cap of the span it was given to
    at = reach.join(segs.select(*key, "seg_id", "c0", "drawn"), [*key, "seg_id"]).groupBy(*key, F.col("point_id").alias("item_id")).agg(
        F.min_by(F.col("c0") + F.col("t") * F.col("drawn"), F.struct("d", "seg_id")).alias("along"))
    ordered = ordered_scan(spots.join(at, [*key, "item_id"]), key, ["along", "item_id"], chunk=F.floor(F.col("along") / 65536), cumsum={"k2": F.lit(1)})
    moved = (runs.select(*key, "lo", "hi", "k", "ax", "ay", "bx", "by", F.col("item_id").alias("old_item"))
             .join(ordered.select(*key, F.col("k2").alias("k"), F.col("item_id").alias("new_item"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("metres").alias("nm")), [*key, "k"])
             .join(spots.select(*key, "lo", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("metres").alias("om")), [*key, "lo"]))
    gap = lambda x, y: point_segment(x, y, "ax", "ay", "bx", "by")["d"]
    moved = moved.withColumns({"_og": gap("ox", "oy"), "_ng": gap("nx", "ny")})
    better = moved.groupBy(*key).agg((F.sum("_ng") < F.sum("_og")).alias("remapped"))
    take = F.col("remapped")
    pick = moved.join(better, key).select("route_id", "lo", F.when(take, F.col("new_item")).otherwise(F.col("old_item")).alias("_item"),
                                          F.when(take, F.col("nm")).otherwise(F.col("om")).alias("_m"), "remapped")
    return spans.join(pick, ["route_id", "lo"], "left").select(
        *EDGE, F.coalesce("_m", "meters").alias("meters"), F.coalesce("_item", "item_id").alias("item_id"), F.coalesce("remapped", F.lit(False)).alias("remapped"))


def monotonic_match(poles: DataFrame, labels: DataFrame, scales: DataFrame) -> DataFrame:
    """Labels in route order each take the best of the next five spans after the last one taken; leftovers are greedy.

    Result: route_id, lo, hi, meters, item_id, source.
    """
    segments, points = span_segments(poles), label_points(labels)
    placed = segments.withColumn("_len", F.col("drawn"))
    placed = ordered_scan(placed, "route_id", "seg_id", chunk=number_chunk("seg_id"), cumsum={"_cum": "_len", "idx": F.lit(1)})
    whole = placed.groupBy("route_id").agg(F.sum("_len").alias("_total"))
    placed = checkpoint(placed.join(whole, "route_id").withColumns({"t0": (F.col("_cum") - F.col("_len")) / F.col("_total"), "tw": F.col("_len") / F.col("_total")})
                        .withColumn("mid", F.col("t0") + F.col("tw") / 2))
    scored = checkpoint(span_candidates(placed, points, scales, max_gap=MONOTONIC_GAP_PT)
                        .join(placed.select("route_id", F.col("seg_id").alias("lid"), "idx", "t0", "tw", "mid"), ["route_id", "lid"]))
    where = scored.groupBy("route_id", "rid").agg(F.min_by(F.col("t0") + F.col("t") * F.col("tw"), F.struct("gap", "lid")).alias("at"))
    options = scored.join(where, ["route_id", "rid"]).withColumn("total", F.col("cost") + ORDER_WEIGHT * F.abs(F.col("mid") - F.col("at")))
    # candidates of one label lie within 90 pt of it, so this list is local
    lists = options.groupBy("route_id", "rid", "at").agg(F.array_sort(F.collect_list(F.struct("total", "idx", "lid"))).alias("opts"))

    def step(state, row):
        allowed = F.filter(row["opts"], lambda o: (o["idx"] >= state["next"]) & (o["idx"] < state["next"] + LOOKAHEAD))
        pick = F.try_element_at(allowed, F.lit(1))
        return F.struct(F.coalesce(pick["idx"] + 1, state["next"]).cast("long").alias("next"), pick["lid"].alias("lid"))

    taken = chunked_fold(lists, "route_id", ["at", "rid"], fields=["opts"], zero=F.struct(F.lit(1).cast("long").alias("next"), F.lit(None).cast("int").alias("lid")),
                         step=step, emit=lambda s, r: F.struct(r["rid"].alias("rid"), s["lid"].alias("lid")), chunk=F.floor(F.col("at") * 64))
    taken = checkpoint(taken.where("lid IS NOT NULL"))
    rest = (scored.join(taken.select("route_id", "lid"), ["route_id", "lid"], "left_anti").join(taken.select("route_id", "rid"), ["route_id", "rid"], "left_anti"))
    filled = greedy_pairs(rest.select("route_id", "lid", "rid", "cost"), ["route_id"]).select("route_id", "lid", "rid")
    both = taken.select("route_id", "lid", "rid", F.lit("monotonic-route").alias("source")).unionByName(filled.withColumn("source", F.lit("monotonic-greedy")))
    named = both.join(points.select("route_id", F.col("item_id").alias("rid"), "metres"), ["route_id", "rid"])
    return (segments.select("route_id", F.col("seg_id").alias("lo"), "hi")
            .join(named.select("route_id", F.col("lid").alias("lo"), F.col("metres").alias("meters"), F.col("rid").alias("item_id"), "source"), ["route_id", "lo"], "left"))


# ---------------------------------------------------------------- de-duplication

def dedupe_poles(poles: DataFrame, calibrated_pages: DataFrame) -> DataFrame:
    """One row per (route_id, number): calibrated pages first, then the highest page, then the latest row."""
    known = calibrated_pages.select(*PAGE, F.lit(1).alias("_cal")).distinct()
    rows = poles.join(known, PAGE, "left")
    rest = [c for c in poles.columns if c not in ("route_id", "number")]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce("_cal", F.lit(0)), "page", "row_id"))
    return rows.groupBy("route_id", "number").agg(best.alias("_b")).select("route_id", "number", "_b.*")


def drop_phantom_skips(spans: DataFrame) -> DataFrame:
    """Drop an inferred span N→N+2 that repeats the label of N→N+1 or N+1→N+2."""
    steps = spans.where("hi = lo + 1 AND meters IS NOT NULL")
    skips = spans.where("hi = lo + 2 AND source = 'inferred-label' AND meters IS NOT NULL")
    same = lambda shift: skips.join(steps.select("route_id", (F.col("lo") - shift).alias("lo"), F.col("meters").alias("_m")), ["route_id", "lo"]) \
        .where(F.abs(F.col("_m") - F.col("meters")) < EXACT_LABEL_M).select(*EDGE)
    return spans.join(same(0).unionByName(same(1)).distinct(), EDGE, "left_anti")


def _incident(spans: DataFrame) -> DataFrame:
    return spans.withColumn("pole", F.explode(F.array("lo", "hi")))


def dedup_equal_at_junction(spans: DataFrame, tol: float = SAME_LABEL_M) -> DataFrame:
    """Clear a non-consecutive span whose length repeats a more authoritative span at a shared pole."""
    rows = _incident(spans.where(F.col("meters") > 0).withColumn("rank", source_rank("source")))
    bucket = F.floor(F.col("meters") / tol)
    strong = rows.where("rank >= 3").select("route_id", "pole", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("meters").alias("_m"), F.col("rank").alias("_r"),
                                           F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    weak = rows.where("hi > lo + 1").withColumn("_b", bucket)
    twins = weak.join(strong, ["route_id", "pole", "_b"]).where((F.abs(F.col("meters") - F.col("_m")) <= tol) & (F.col("rank") < F.col("_r")))
    return _clear(spans, twins.select(*EDGE).distinct(), "phantom-dedup-cleared")


def _clear(spans: DataFrame, edges: DataFrame, source: str) -> DataFrame:
    """Null the metres of the listed edges and leave a tombstone source."""
    marked = spans.join(edges.withColumn("_x", F.lit(True)), EDGE, "left")
    hit = F.col("_x").isNotNull()
    return marked.withColumns({"meters": F.when(~hit, F.col("meters")), "source": F.when(hit, source).otherwise(F.col("source"))}).drop("_x")


def demote_duplicates(spans: DataFrame, labels: DataFrame | None = None, poles: DataFrame | None = None) -> DataFrame:
    """Source window-refine-duplicate for a refined span that repeats an adjacent direct claim; with labels and poles,
    also for a trusted span whose printed label lies nearer the chord of its invented twin."""
    invented = ["jumpback-refill", "inferred-label"]
    steps = spans.where("hi = lo + 1 AND meters > 0")

    def adjacent(rows, other):
        near = lambda shift: rows.join(other.select("route_id", (F.col("lo") + shift).alias("lo"), F.col("meters").alias("_m"), F.col("lo").alias("_tlo")), ["route_id", "lo"])
        return near(1).unionByName(near(-1)).where(F.abs(F.col("_m") - F.col("meters")) < EXACT_LABEL_M)

    direct = steps.where(~F.coalesce(F.col("source").isin(invented), F.lit(False)))
    first = adjacent(steps.where("source = 'window-refine'"), direct).select(*EDGE).distinct()
    hits = first
    if labels is not None and poles is not None:
        trusted = steps.where(F.col("source").isNotNull() & ~F.col("source").isin(*invented, "window-refine-duplicate")).join(first, EDGE, "left_anti")
        twins = adjacent(trusted, steps.where(F.col("source").isin(invented)))
        segments = span_segments(poles).where("NOT cross").select(*PAGE, "seg_id", "ax", "ay", "bx", "by")
        points = label_points(labels)

        def gap(on, name):
            chords = twins.join(segments.withColumnRenamed("seg_id", on), ["route_id", on]).select("route_id", "page", "lo", "_tlo", "meters", "ax", "ay", "bx", "by")
            bucket = F.floor(F.col("metres") / EXACT_LABEL_M)
            filed = points.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
            met = chords.withColumn("_b", F.floor(F.col("meters") / EXACT_LABEL_M)).join(filed, [*PAGE, "_b"]).where(F.abs(F.col("metres") - F.col("meters")) < EXACT_LABEL_M)
            return met.groupBy("route_id", "lo", "_tlo").agg(F.min(point_segment("x", "y", "ax", "ay", "bx", "by")["d"]).alias(name))

        both = gap("lo", "_own").join(gap("_tlo", "_twin"), ["route_id", "lo", "_tlo"]).where("_own > _twin")
        hits = hits.unionByName(both.select("route_id", "lo", (F.col("lo") + 1).alias("hi"))).distinct()
    marked = spans.join(hits.withColumn("_x", F.lit(True)), EDGE, "left")
    return marked.withColumn("source", F.when(F.col("_x"), "window-refine-duplicate").otherwise(F.col("source"))).drop("_x")


def drop_conflicting(spans: DataFrame, claims: DataFrame) -> DataFrame:
    """Drop non-consecutive spans that carry the length of a claimed span. claims: route_id, lo, hi, meters."""
    far = spans.where("hi > lo + 1 AND meters IS NOT NULL")
    bucket = F.floor(F.col("_m") / EXACT_LABEL_M)
    filed = claims.select("route_id", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("meters").alias("_m")).withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    met = far.withColumn("_b", F.floor(F.col("meters") / EXACT_LABEL_M)).join(filed, ["route_id", "_b"])
    gone = met.where((F.abs(F.col("_m") - F.col("meters")) <= EXACT_LABEL_M) & ~((F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")))).select(*EDGE).distinct()
    return spans.join(gone, EDGE, "left_anti")


def jumpbacks(spans: DataFrame, poles: DataFrame) -> DataFrame:
    """Branch-return jumps lo→hi of 4 to 6 numbers, with an active lo→lo+1 and all three poles present."""
    active = spans.where(F.col("meters") > 0)
    starts = active.where("hi = lo + 1").select("route_id", "lo")
    at = lambda name: poles.select("route_id", F.col("number").alias(name)).distinct()
    jumps = active.where("hi - lo BETWEEN 4 AND 6").select(*EDGE).withColumn("tip", F.col("hi") - 1)
    return (jumps.join(starts, ["route_id", "lo"], "left_semi").join(at("lo"), ["route_id", "lo"], "left_semi")
            .join(at("hi"), ["route_id", "hi"], "left_semi").join(at("tip"), ["route_id", "tip"], "left_semi"))


def suppress_jumpbacks(spans: DataFrame, poles: DataFrame) -> DataFrame:
    """Tombstone the step into each rejoin and clear the step after it; missing tombstone rows are added."""
    jumps = jumpbacks(spans, poles)
    into = jumps.select("route_id", F.col("tip").alias("lo"), "hi").distinct()
    after = (jumps.select("route_id", F.col("hi").alias("lo"), (F.col("hi") + 1).alias("hi")).distinct()
             .join(poles.select("route_id", F.col("number").alias("hi")).distinct(), ["route_id", "hi"], "left_semi"))
    marks = into.withColumn("_k", F.lit("into")).unionByName(after.join(into, EDGE, "left_anti").withColumn("_k", F.lit("after")).select(*EDGE, "_k"))
    rows = spans.join(marks, EDGE, "left")
    source = F.when(F.col("_k") == "into", "jumpback-suppressed").when((F.col("_k") == "after") & F.col("meters").isNotNull(), None).otherwise(F.col("source"))
    kept = rows.select(*EDGE, F.when(F.col("_k").isNull(), F.col("meters")).alias("meters"), source.alias("source"))
    added = into.join(spans.select(*EDGE), EDGE, "left_anti").select(*EDGE, F.lit(None).cast("double").alias("meters"), F.lit("jumpback-suppressed").alias("source"))
    return kept.unionByName(added)


def refill_spans(spans: DataFrame, labels: DataFrame, poles: DataFrame, scales: DataFrame, source: str = "jumpback-refill") -> DataFrame:
    """Give empty consecutive spans (not tombstoned) the best free label, by the usual score.

    spans may carry item_id of the label they hold; labels in use are not taken again.
    """
    frozen = F.coalesce(F.col("source").isin(*BLOCKING_SOURCES, "bifurcation-tap", "bifurcation-main"), F.lit(False))
    empty = spans.where("hi = lo + 1 AND meters IS NULL").where(~frozen).select("route_id", F.col("lo").alias("seg_id"))
    free = labels.join(spans.where("item_id IS NOT NULL").select("route_id", "item_id").distinct(), ["route_id", "item_id"], "left_anti")
    segments = span_segments(poles).join(empty, ["route_id", "seg_id"], "left_semi")
    won = greedy_pairs(span_candidates(segments, label_points(free), scales), ["route_id"])
    got = won.select("route_id", F.col("lid").alias("lo"), "hi", F.col("metres").alias("_m"), F.col("rid").alias("_i"))
    rows = spans.join(got, EDGE, "left")
    return rows.select(*EDGE, F.coalesce("meters", "_m").alias("meters"), F.when(F.col("_m").isNotNull(), source).otherwise(F.col("source")).alias("source"), F.coalesce("item_id", "_i").alias("item_id"))


def shift_after_jumpback(spans: DataFrame, suppressed: DataFrame, poles: DataFrame) -> DataFrame:
    """Move the label cleared from a rejoin step (tip→hi) to hi→hi+1, and drop far spans that repeat it.

    spans: before suppression; suppressed: suppress_jumpbacks of them. Source jumpback-shift.
    """
    before = spans.select(*EDGE, F.col("meters").alias("_old"))
    cleared = suppressed.where("source = 'jumpback-suppressed'").join(before, EDGE).where("_old > 0")
    moves = cleared.select("route_id", F.col("hi").alias("lo"), (F.col("hi") + 1).alias("hi"), F.col("_old").alias("_m")).groupBy(*EDGE).agg(F.max("_m").alias("_m"))
    moves = moves.join(suppressed.where("NOT (source <=> 'jumpback-suppressed')").select(*EDGE), EDGE, "left_semi")
    moved = suppressed.join(moves, EDGE, "left").select(*EDGE, F.coalesce("_m", "meters").alias("meters"), F.when(F.col("_m").isNotNull(), "jumpback-shift").otherwise(F.col("source")).alias("source"))
    return drop_conflicting(moved, moves.withColumnRenamed("_m", "meters"))


def rescue_orphans(poles: DataFrame, labels: DataFrame, spans: DataFrame, taps: DataFrame) -> DataFrame:
    """Give empty same-page spans beside off-cable poles the nearest free label that no labelled span is nearer to.

    Candidates need a gap of at most 52 pt, and no labelled span within 0.88 of it. Matching is one to one, smallest
    gap first. taps: route_id, number. Result: route_id, lo, hi, meters, item_id.
    """
    segments = span_segments(poles).where("NOT cross")
    points = label_points(labels)
    active = spans.where("hi = lo + 1 AND meters > 0").select("route_id", F.col("lo").alias("seg_id"))
    met = near_segments(points.withColumnRenamed("item_id", "point_id"), segments, ORPHAN_GAP_PT)
    held = met.join(active, ["route_id", "seg_id"], "left_semi").groupBy("route_id", "point_id").agg(F.min("d").alias("_held"))
    beside = taps.select("route_id", F.explode(F.array(F.col("number"), F.col("number") - 1)).alias("seg_id")).distinct()
    rows = (met.join(active, ["route_id", "seg_id"], "left_anti").join(beside, ["route_id", "seg_id"], "left_semi").join(held, ["route_id", "point_id"], "left")
            .where(F.coalesce(F.col("_held") >= F.col("d") * ORPHAN_FACTOR, F.lit(True))))
    won = greedy_pairs(rows.select("route_id", F.col("seg_id").alias("lid"), F.col("point_id").alias("rid"), F.col("d").alias("cost")), ["route_id"])
    named = won.join(points.select("route_id", F.col("item_id").alias("rid"), "metres"), ["route_id", "rid"])
    return named.select("route_id", F.col("lid").alias("lo"), (F.col("lid") + 1).alias("hi"), F.col("metres").alias("meters"), F.col("rid").alias("item_id"))


def merge_split_labels(spans: DataFrame, labels: DataFrame, poles: DataFrame, scales: DataFrame) -> DataFrame:
    """Add the second part of a label that a crossing split: where the drawn span clearly exceeds its label and one
    unused label on the chord makes up the difference.

    Unused means that no span of the route prints its value. Result: spans plus merged flag.
    """
    segments = span_segments(poles).where("NOT cross")
    held = spans.where("hi = lo + 1 AND meters > 0").select("route_id", F.col("lo").alias("seg_id"), "meters")
    long = (segments.join(held, ["route_id", "seg_id"]).join(scales.select(*PAGE, "scale"), PAGE).withColumn("_chord", F.col("drawn") * F.col("scale"))
            .where((F.col("drawn") > 5) & (F.col("_chord") / F.col("meters") >= SPLIT_RATIO)))
    tenth = F.round(F.col("metres") * 10)
    used = spans.where(F.col("meters") > 0).select("route_id", F.explode(F.array(*[F.round(F.col("meters") * 10) + i for i in (-1, 0, 1)])).alias("_v"), F.col("meters").alias("_um"))
    points = label_points(labels)
    taken = points.withColumn("_v", tenth).join(used, ["route_id", "_v"]).where(F.abs(F.col("_um") - F.col("metres")) < EXACT_LABEL_M).select("route_id", "item_id").distinct()
    free = points.join(taken, ["route_id", "item_id"], "left_anti")
    met = near_segments(free.withColumnRenamed("item_id", "point_id"), long, SPLIT_GAP_PT).where(F.col("t").between(0.05, 0.95))
    rows = met.join(long.select("route_id", "seg_id", "meters", "_chord"), ["route_id", "seg_id"]).join(free.select("route_id", F.col("item_id").alias("point_id"), "metres"), ["route_id", "point_id"])
    fits = rows.where(F.abs(F.col("meters") + F.col("metres") - F.col("_chord")) / F.col("_chord") <= SPLIT_SUM_TOL)
    won = greedy_pairs(fits.select("route_id", F.col("seg_id").alias("lid"), F.col("point_id").alias("rid"), F.col("d").alias("cost"), "metres"), ["route_id"])
    extra = won.select("route_id", F.col("lid").alias("lo"), (F.col("lid") + 1).alias("hi"), F.col("metres").alias("_m"))
    return spans.join(extra, EDGE, "left").withColumns({"merged": F.col("_m").isNotNull(), "meters": F.when(F.col("_m").isNotNull(), F.round(F.col("meters") + F.col("_m"), 2)).otherwise(F.col("meters"))}).drop("_m")


def swap_at_junction(spans: DataFrame, labels: DataFrame, poles: DataFrame, degree: DataFrame) -> DataFrame:
    """Swap the labels of J→J+1 and J+1→J+2 at a junction (degree ≥3) where both labels lie on the other's chord.

    degree: label_degree output.
    """
    steps = spans.where("hi = lo + 1 AND meters > 0").select("route_id", "lo", F.col("meters").alias("m"))
    segs = span_segments(poles).where("NOT cross").select(*PAGE, F.col("seg_id").alias("lo"), F.struct("ax", "ay", "bx", "by").alias("c"))
    first = steps.join(segs, ["route_id", "lo"]).join(degree.where("degree >= 3").select("route_id", F.col("number").alias("lo")), ["route_id", "lo"], "left_semi")
    second = steps.join(segs, ["route_id", "lo"]).select(*PAGE, (F.col("lo") - 1).alias("lo"), F.col("m").alias("m2"), F.col("c").alias("c2"))
    pairs = first.join(second, [*PAGE, "lo"]).where(F.abs(F.col("m") - F.col("m2")) >= SWAP_MIN_M)
    points = label_points(labels)
    bucket = F.floor(F.col("metres") / SAME_LABEL_M)
    filed = points.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))

    def gaps(value, name):
        met = pairs.withColumn("_b", F.floor(F.col(value) / SAME_LABEL_M)).join(filed, [*PAGE, "_b"]).where(F.abs(F.col("metres") - F.col(value)) <= SAME_LABEL_M)
        to = lambda c: F.min(point_segment("x", "y", f"{c}.ax", f"{c}.ay", f"{c}.bx", f"{c}.by")["d"])
        return met.groupBy("route_id", "lo").agg(to("c").alias(f"{name}1"), to("c2").alias(f"{name}2"))

    cost = pairs.select("route_id", "lo", "m", "m2").join(gaps("m", "a"), ["route_id", "lo"]).join(gaps("m2", "b"), ["route_id", "lo"])
    ok = (F.col("a2") <= SWAP_ON_CHORD_PT) & (F.col("b1") <= SWAP_ON_CHORD_PT) & (F.col("a2") + F.col("b1") + SWAP_GAIN_PT < F.col("a1") + F.col("b2"))
    swaps = cost.where(ok)
    chained = swaps.select("route_id", (F.col("lo") + 1).alias("lo"))
    swaps = swaps.join(chained, ["route_id", "lo"], "left_anti")  # one swap per span and round, lowest junction first
    new = swaps.select("route_id", "lo", F.col("m2").alias("_m")).unionByName(swaps.select("route_id", (F.col("lo") + 1).alias("lo"), F.col("m").alias("_m"))).withColumn("hi", F.col("lo") + 1)
    return spans.join(new, EDGE, "left").withColumns({"source": F.when(F.col("_m").isNotNull(), "dense-junction-swap").otherwise(F.col("source")), "meters": F.coalesce("_m", "meters")}).drop("_m")


# ---------------------------------------------------------------- branches

def rehome_branch_arms(spans: DataFrame, labels: DataFrame, poles: DataFrame, degree: DataFrame, cable_hits: DataFrame, topology: DataFrame | None = None) -> DataFrame:
    """Move a label that a consecutive span took from a branch arm to (junction, far), leaving a tombstone.

    A label qualifies when its value sits on a consecutive span near a junction of label degree ≥3, it lies on the cable
    (cable_hits: route_id, item_id, d) and within 150 pt of the junction, and the arm to one of the span's ends fits it:
    bearing within 12°, gap at most 30 pt and 8 pt better than the span, no pole between nearer to the label. topology
    (route_id, number, neighbour) restricts arms to base-map cable neighbours. The best arm per label wins.
    """
    points = label_points(labels).join(cable_hits.where(F.col("d") <= ARM_ON_CABLE_PT).select("route_id", "item_id"), ["route_id", "item_id"], "left_semi")
    at = poles.select(*PAGE, "number", "x", "y")
    junctions = at.join(degree.where("degree >= 3").select("route_id", "number"), ["route_id", "number"], "left_semi")
    segs = span_segments(poles).where("NOT cross")
    tenth = lambda c: F.floor(F.col(c) / SAME_LABEL_M)
    held = (spans.where("hi = lo + 1 AND meters > 0").select("route_id", F.col("lo").alias("seg_id"), "meters")
            .join(segs.select("route_id", "page", "seg_id", "ax", "ay", "bx", "by"), ["route_id", "seg_id"]).withColumn("_b", F.explode(F.array(tenth("meters") - 1, tenth("meters"), tenth("meters") + 1))))
    stolen = points.withColumn("_b", tenth("metres")).join(held, [*PAGE, "_b"]).where(F.abs(F.col("metres") - F.col("meters")) <= SAME_LABEL_M)
    stolen = stolen.withColumn("_sg", point_segment("x", "y", "ax", "ay", "bx", "by")["d"])
    from routekit.operators.core import radius_pairs
    from routekit.operators.matching import side
    near = (radius_pairs(side(points, "l", "item_id"), side(junctions, "r", "number"), ARM_NEAR_PT, PAGE)
            .select(*PAGE, F.col("lid").alias("item_id"), F.col("rid").alias("junction"), F.col("rx").alias("jx"), F.col("ry").alias("jy"), F.col("d").alias("jd")))
    arms = stolen.join(near, [*PAGE, "item_id"]).withColumn("far", F.explode(F.array(F.col("seg_id"), F.col("seg_id") + 1))).where("far >= junction + 2")
    if topology is not None:
        arms = arms.join(topology.select("route_id", F.col("number").alias("junction"), F.col("neighbour").alias("far")), ["route_id", "junction", "far"], "left_semi")
    arms = arms.join(at.select(*PAGE, F.col("number").alias("far"), F.col("x").alias("fx"), F.col("y").alias("fy")), [*PAGE, "far"])
    turn = F.abs(F.atan2(F.col("y") - F.col("jy"), F.col("x") - F.col("jx")) - F.atan2(F.col("fy") - F.col("jy"), F.col("fx") - F.col("jx")))
    bearing = F.degrees(F.least(turn, 2 * F.pi() - turn))
    arms = arms.withColumns({"_ag": point_segment("x", "y", "jx", "jy", "fx", "fy")["d"], "_turn": bearing})
    arms = arms.where((F.col("_turn") <= ARM_BEARING_DEG) & (F.col("_ag") <= ARM_GAP_PT) & (F.col("_ag") + ARM_GAIN_PT <= F.col("_sg")))
    between = nearest_poles(points, poles, 1).select("route_id", "item_id", F.col("number").alias("_near"))
    arms = arms.join(between, ["route_id", "item_id"]).where(~((F.col("_near") > F.col("junction")) & (F.col("_near") < F.col("far"))))
    best = arms.groupBy("route_id", "item_id").agg(F.min(F.struct("_ag", "junction", "far", "seg_id", "metres")).alias("_b")).select("route_id", "_b.*")
    claims = best.groupBy("route_id", F.col("junction").alias("lo"), F.col("far").alias("hi")).agg(F.min(F.struct("_ag", "seg_id", "metres")).alias("_c")).select(*EDGE, "_c.seg_id", "_c.metres")
    claims = checkpoint(claims)
    source = "branch-arm-rehomed" if topology is None else "branch-arm-rehomed-topology"
    left_behind = claims.select("route_id", F.col("seg_id").alias("lo"), (F.col("seg_id") + 1).alias("hi")).distinct()
    cleared = _clear(spans.select(*EDGE, "meters", "source"), left_behind, "branch-arm-rehomed-cleared")
    added = claims.select(*EDGE, F.col("metres").alias("meters"), F.lit(source).alias("source"))
    return cleared.join(added.select(*EDGE), EDGE, "left_anti").unionByName(added)


def revert_false_bifurcations(spans: DataFrame, topology: DataFrame) -> DataFrame:
    """Clear bifurcation-main J→J+2 where J has two or more cable neighbours and all of them are J±1."""
    known = topology.groupBy("route_id", "number").agg(F.count("*").alias("_n"), F.bool_and(F.abs(F.col("neighbour") - F.col("number")) == 1).alias("_plain"))
    plain = known.where("_n >= 2 AND _plain").select("route_id", F.col("number").alias("lo"))
    wrong = spans.where("source = 'bifurcation-main' AND hi = lo + 2").select(*EDGE).join(plain, ["route_id", "lo"], "left_semi")
    return _clear(spans, wrong, "bifurcation-reverted")


def _active_prefix(spans: DataFrame) -> DataFrame:
    """Count of active steps N→N+1 below each number: route_id, number, k (steps lo < number)."""
    steps = spans.where("hi = lo + 1").groupBy("route_id", "lo").agg(F.max(has_active_metres("meters").cast("int")).alias("_a"))
    return ordered_scan(steps, "route_id", "lo", chunk=number_chunk("lo"), cumsum={"_k": "_a"})


def _all_active(pairs: DataFrame, spans: DataFrame, lo: str, hi: str) -> DataFrame:
    """Keep pairs whose every step lo..hi is active; lo = hi counts as active."""
    prefix = checkpoint(_active_prefix(spans))
    start = prefix.select("route_id", F.col("lo").alias(lo), (F.col("_k") - F.col("_a")).alias("_k0"))
    end = prefix.select("route_id", (F.col("lo") + 1).alias(hi), F.col("_k").alias("_k1"))
    rows = pairs.join(start, ["route_id", lo], "left").join(end, ["route_id", hi], "left")
    return rows.where((F.col(lo) == F.col(hi)) | (F.col("_k1") - F.col("_k0") == F.col(hi) - F.col(lo))).drop("_k0", "_k1")


def redundant_chords(spans: DataFrame) -> DataFrame:
    """Inferred non-consecutive spans whose every step is active."""
    chords = spans.where("source = 'inferred-label' AND hi > lo + 1").select(*EDGE)
    return _all_active(chords, spans, "lo", "hi").select(*EDGE)


def drop_redundant_chords(spans: DataFrame) -> DataFrame:
    return spans.join(redundant_chords(spans), EDGE, "left_anti")


def branch_returns(spans: DataFrame) -> DataFrame:
    """Branches that leave the main route at a junction and rejoin it: route_id, junction, rejoin, tip.

    junction→rejoin is an active inferred or main span, junction→+1 is active, tip→rejoin is tombstoned and the steps
    between are active. The nearest junction wins per rejoin.
    """
    active = spans.where(F.col("meters") > 0)
    taps = active.where("hi = lo + 1").select("route_id", F.col("lo").alias("junction"))
    blocked = spans.where("hi = lo + 1").where(is_blocked("meters", "source")).select("route_id", F.col("hi").alias("rejoin"))
    jumps = (active.where("hi > lo + 1").where(F.col("source").isin("inferred-label", "bifurcation-main"))
             .select("route_id", F.col("lo").alias("junction"), F.col("hi").alias("rejoin"))
             .join(taps, ["route_id", "junction"], "left_semi").join(blocked, ["route_id", "rejoin"], "left_semi")
             .withColumns({"_from": F.col("junction") + 1, "tip": F.col("rejoin") - 1}))
    whole = _all_active(jumps, spans, "_from", "tip")
    return whole.groupBy("route_id", "rejoin").agg(F.max("junction").alias("junction")).select("route_id", "junction", "rejoin", (F.col("rejoin") - 1).alias("tip"))


def finalize_connections(conns: DataFrame, spans: DataFrame) -> DataFrame:
    """Final connection list: tombstoned and redundant edges out, main edges of returns and bifurcations in.

    conns: route_id, src, dst, meters, source. A two-step main edge J→J+2 displaces J+1→J+2.
    """
    returns = checkpoint(branch_returns(spans))
    redundant = checkpoint(redundant_chords(spans))
    pair = ["route_id", "src", "dst"]
    as_conn = lambda df: df.select("route_id", F.col("lo").alias("src"), F.col("hi").alias("dst"))
    blocked = as_conn(spans.where(is_blocked("meters", "source")))
    tips = returns.select("route_id", F.col("tip").alias("src"), F.col("rejoin").alias("dst"))
    inferred = spans.where("source = 'inferred-label' AND meters > 0").select("route_id", "lo", F.col("hi").alias("rejoin"))
    early = inferred.join(returns, ["route_id", "rejoin"]).where("lo < junction").select("route_id", F.col("lo").alias("src"), F.col("rejoin").alias("dst"))
    drops = blocked.unionByName(as_conn(redundant)).unionByName(tips).unionByName(early).distinct()
    main = spans.where("source = 'bifurcation-main' AND meters > 0").select("route_id", F.col("lo").alias("src"), F.col("hi").alias("dst"), "meters", "source").join(drops, pair, "left_anti")
    displaced = main.where("dst = src + 2").select("route_id", (F.col("src") + 1).alias("src"), "dst")
    lengths = spans.groupBy("route_id", F.col("lo").alias("src"), F.col("hi").alias("dst")).agg(F.max("meters").alias("meters"))
    rejoin = returns.select("route_id", F.col("junction").alias("src"), F.col("rejoin").alias("dst")).join(lengths, pair, "left").withColumn("source", F.lit("inferred-label"))
    added = rejoin.unionByName(main.join(rejoin.select(*pair), pair, "left_anti")).join(conns.select(*pair), pair, "left_anti")
    full = conns.select(*pair, "meters", "source").unionByName(added)
    return full.join(drops.unionByName(displaced).distinct(), pair, "left_anti")


def complete_consecutive(conns: DataFrame, poles: DataFrame, spans: DataFrame, scales: DataFrame) -> DataFrame:
    """Add implied connections so that every consecutive pole pair has one: printed length, else the drawn one."""
    from routekit.functions import bearing_deg, haversine_m, page_bearing
    pair = ["route_id", "src", "dst"]
    linked = ordered_scan(poles, "route_id", "number", chunk=number_chunk(), lead={"_n": F.struct("number", "page", "x", "y", "lat", "lon")}).where("_n IS NOT NULL")
    rows = linked.withColumns({"src": F.col("number"), "dst": F.col("_n.number")}).join(conns.select(*pair), pair, "left_anti")
    rows = rows.join(conns.select("route_id", F.col("dst").alias("src"), F.col("src").alias("dst")), pair, "left_anti")
    labels = spans.where("meters IS NOT NULL").groupBy("route_id", F.col("lo").alias("src"), F.col("hi").alias("dst")).agg(F.max("meters").alias("_m"))
    rows = rows.join(labels, pair, "left").join(scales.select(*PAGE, "scale"), PAGE, "left")
    cross = F.col("page") != F.col("_n.page")
    geo = haversine_m("lat", "lon", "_n.lat", "_n.lon")
    drawn = dist2d("x", "y", "_n.x", "_n.y") * F.col("scale")
    metres = F.when(cross, F.coalesce(geo, F.lit(0.0))).otherwise(F.coalesce("_m", drawn, F.lit(0.0)))
    bearing = F.when(cross, F.coalesce(bearing_deg("lat", "lon", "_n.lat", "_n.lon"), F.lit(0.0))).otherwise(page_bearing("x", "y", "_n.x", "_n.y"))
    implied = rows.select(*pair, metres.alias("meters"), bearing.alias("bearing"), cross.alias("cross_page"), F.lit(True).alias("implied"))
    given = conns.select(*pair, "meters", "bearing", "cross_page", F.lit(False).alias("implied"))
    return given.unionByName(implied)
