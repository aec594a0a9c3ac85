"""Ordered-row operators along a route: neighbours, runs, number repair, imputation, ordering."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routekit.functions import dist2d, haversine_m, is_truncated, nineties_candidates, span_tolerance
from routekit.operators.core import checkpoint, chunked_fold, number_chunk, ordered_scan
from routekit.operators.fits import principal_axis

PAGE = ["route_id", "page"]
# Bracket rule, column width, message texts.
BRACKET_MISFIT_M, BRACKET_RATIO, BRACKET_MOVE_PT = 12.0, 1.55, 8.0
COLUMN_PT = 10.0
PHRASES = {"sandwich": "entre os postes %d e %d", "between": "entre os postes %d e %d na folha",
           "after": "após o poste %d", "before": "antes do poste %d", "none": "sequência da rota na folha"}


def consecutive(poles: DataFrame) -> DataFrame:
    """Each pole with the next one by number: adds next_number, next_page, next_x, next_y."""
    out = ordered_scan(poles, "route_id", ["number", "row_id"] if "row_id" in poles.columns else "number",
                       chunk=number_chunk(), lead={"_n": F.struct("number", "page", "x", "y")})
    return out.select("*", *[F.col(f"_n.{c}").alias(f"next_{c}") for c in ("number", "page", "x", "y")]).drop("_n")


def number_runs(poles: DataFrame, by=("route_id", "page")) -> DataFrame:
    """Add run: its first number, for maximal runs of consecutive numbers."""
    return _runs(poles, list(by), F.col("number") - F.col("_prev.number") > 1)


def split_runs(poles: DataFrame, branches: DataFrame) -> DataFrame:
    """Add run: its first number, for runs that end where the page changes or a branch starts.

    branches: (route_id, number) of branch-start poles.
    """
    marked = poles.join(branches.select("route_id", "number", F.lit(True).alias("_start")).distinct(), ["route_id", "number"], "left")
    return _runs(marked, ["route_id"], (F.col("page") != F.col("_prev.page")) | F.coalesce("_start", F.lit(False))).drop("_start")


def _runs(poles: DataFrame, by, breaks: Column) -> DataFrame:
    seen = ordered_scan(poles, by, "number", chunk=number_chunk(), lag={"_prev": F.struct("number", "page")})
    opens = F.col("_prev").isNull() | F.coalesce(breaks, F.lit(False))
    marked = seen.withColumn("_open", F.when(opens, F.col("number")))
    return ordered_scan(marked, by, "number", chunk=number_chunk(), cummax={"run": "_open"}).drop("_prev", "_open")


# ---------------------------------------------------------------- number repair

def context_numbers(readings: DataFrame) -> DataFrame:
    """Add n_readings, ctx (usable number: in range, or a repaired nineties misread) and label (ctx with a lone digit
    read as its fifties form). readings: route_id, pos (reading order), page, number."""
    counts = readings.groupBy("route_id").agg(F.count("*").cast("int").alias("n_readings"))
    n, top = F.col("number"), F.col("n_readings")
    ctx = F.when(n.between(1, top), n).otherwise(F.try_element_at(nineties_candidates("number", top), F.lit(1)))
    label = F.when((n <= 9) & (F.col("ctx") <= 9) & (n + 50 <= top), n + 50).otherwise(F.col("ctx"))
    return readings.join(counts, "route_id").withColumn("ctx", ctx).withColumn("label", label)


def with_neighbours(context: DataFrame) -> DataFrame:
    """Add before/after: nearest usable reading on the page, else the edge reading of the adjacent page."""
    mark = F.when(F.col("ctx").isNotNull(), F.struct("ctx", "label", "pos"))
    rows = ordered_scan(context, PAGE, "pos", chunk=number_chunk("pos"), last={"_b": mark}, following={"_a": mark})
    edge = F.struct("ctx", "label", "pos")
    edges = context.groupBy(*PAGE).agg(F.max_by(edge, "pos").alias("_last"), F.min_by(edge, "pos").alias("_first"))
    prev = edges.select("route_id", (F.col("page") + 1).alias("page"), F.when(F.col("_last.ctx").isNotNull(), F.col("_last")).alias("_pe"))
    nxt = edges.select("route_id", (F.col("page") - 1).alias("page"), F.when(F.col("_first.ctx").isNotNull(), F.col("_first")).alias("_ne"))
    return (rows.join(prev, PAGE, "left").join(nxt, PAGE, "left")
            .withColumns({"before": F.coalesce("_b", "_pe"), "after": F.coalesce("_a", "_ne")}).drop("_b", "_a", "_pe", "_ne"))


def _sandwich(lo: Column, hi: Column) -> Column:
    return F.when(hi - lo == 2, lo + 1)


def sandwich_fill(readings: DataFrame) -> DataFrame:
    """Fill an unread number between neighbours N and N+2 with N+1: adds filled."""
    rows = with_neighbours(context_numbers(readings))
    fill = _sandwich(F.col("before.ctx"), F.col("after.ctx"))
    return rows.withColumn("filled", F.coalesce("number", fill))


def has_label_around(context: DataFrame, target: Column) -> DataFrame:
    """Add seen_before, seen_after: does the page carry label `target` before/after this row? The edge label of the
    adjacent page counts too."""
    named = context.withColumn("_t", target)
    at = context.where("label IS NOT NULL").groupBy(*PAGE, F.col("label").alias("_t")).agg(F.min("pos").alias("_p0"), F.max("pos").alias("_p1"))
    edge = context.where("label IS NOT NULL").groupBy(*PAGE).agg(F.max_by("label", "pos").alias("_last"), F.min_by("label", "pos").alias("_first"))
    prev = edge.select("route_id", (F.col("page") + 1).alias("page"), F.col("_last").alias("_le"))
    nxt = edge.select("route_id", (F.col("page") - 1).alias("page"), F.col("_first").alias("_fe"))
    rows = named.join(at, [*PAGE, "_t"], "left").join(prev, PAGE, "left").join(nxt, PAGE, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns({"seen_before": yes(F.col("_p0") < F.col("pos")) | yes(F.col("_le") == F.col("_t")),
                             "seen_after": yes(F.col("_p1") > F.col("pos")) | yes(F.col("_fe") == F.col("_t"))}) \
        .drop("_t", "_p0", "_p1", "_le", "_fe")


def typo_expected(context: DataFrame) -> DataFrame:
    """(route_id, pos, typo): the number a truncated reading should have been, from labels N-1 before and N+1 after.

    Readings have at most three digits, so a page has at most 999 labels to try.
    """
    suspects = context.where((F.col("number") <= 9) | F.col("number").between(25, 45))
    spots = context.where("label IS NOT NULL").groupBy(*PAGE, "label").agg(F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    edge = context.where("label IS NOT NULL").groupBy(*PAGE).agg(F.max_by("label", "pos").alias("_last"), F.min_by("label", "pos").alias("_first"))
    low = spots.selectExpr("route_id", "page", "label + 1 AS exp", "p0").unionByName(
        edge.selectExpr("route_id", "page + 1 AS page", "_last + 1 AS exp", "-1 AS p0")).groupBy(*PAGE, "exp").agg(F.min("p0").alias("p0"))
    high = spots.selectExpr("route_id", "page", "label - 1 AS exp", "p1").unionByName(
        edge.selectExpr("route_id", "page - 1 AS page", "_first - 1 AS exp", "2147483647 AS p1")).groupBy(*PAGE, "exp").agg(F.max("p1").alias("p1"))
    options = low.join(high, [*PAGE, "exp"], "left")
    tried = suspects.select(*PAGE, "pos", "number", "n_readings").join(options, PAGE)
    fits = is_truncated("number", "exp") & F.col("exp").between(1, F.col("n_readings")) & (F.col("p0") < F.col("pos"))
    closed = F.col("p1") > F.col("pos")
    digit = (F.col("number") <= 9) & ((F.col("exp") - F.col("number")) % 10 == 0)
    return tried.where(fits & (F.coalesce(closed, F.lit(False)) | digit)).groupBy("route_id", "pos").agg(F.min("exp").alias("typo"))


def repair_sequence(readings: DataFrame) -> DataFrame:
    """Assign numbers to misread or unread markers: adds assigned (null: skipped), action (kept/renumbered/skipped).

    Order of evidence: truncated-reading repair, N/N+2 neighbours, nineties repair, interpolation between neighbours,
    offset from the one neighbour.
    """
    context = context_numbers(readings)
    rows = with_neighbours(context).join(typo_expected(context), ["route_id", "pos"], "left")
    lo, hi, n, top = F.col("before.ctx"), F.col("after.ctx"), F.col("number"), F.col("n_readings")
    sandwich = _sandwich(lo, hi)
    yes = lambda c: F.coalesce(c, F.lit(False))
    outlier = F.col("typo").isNotNull() & ~yes(sandwich == n)
    short = yes((n <= 9) & (sandwich > 9) & is_truncated(n, sandwich))
    kept = yes(n.between(1, top)) & ~outlier & ~short
    at = F.col("pos") - F.col("before.pos")
    between = F.when(hi > lo, lo + F.floor((hi - lo) * at / (F.col("after.pos") - F.col("before.pos")) + 0.5))
    one_sided = F.when(F.col("after").isNull(), lo + at).when(F.col("before").isNull(), hi - (F.col("after.pos") - F.col("pos")))
    guess = F.coalesce(F.col("typo"), sandwich, F.try_element_at(nineties_candidates("number", top), F.lit(1)), between, one_sided).cast("int")
    assigned = F.when(kept, n).when(guess.between(1, top), guess)
    action = F.when(F.col("assigned").isNull(), "skipped").when(n.eqNullSafe(F.col("assigned")), "kept").otherwise("renumbered")
    return rows.withColumn("assigned", assigned).withColumn("action", action)


def context_phrases(context: DataFrame) -> DataFrame:
    """Add phrase: where in the numbering a notice applies."""
    rows = context if "before" in context.columns else with_neighbours(context)
    lo, hi = F.col("before.label"), F.col("after.label")
    say = lambda key, *args: F.format_string(PHRASES[key], *args) if args else F.lit(PHRASES[key])
    return rows.withColumn("phrase", F.when(hi - lo == 2, say("sandwich", lo, hi)).when(lo.isNotNull() & hi.isNotNull(), say("between", lo, hi))
                           .when(lo.isNotNull(), say("after", lo)).when(hi.isNotNull(), say("before", hi)).otherwise(say("none")))


# ---------------------------------------------------------------- labels along the chain

def span_rows(poles: DataFrame, spans: DataFrame, arcs: DataFrame | None = None) -> DataFrame:
    """One row per pole pair that is consecutive in the route, with its label and drawn lengths.

    Columns: route_id, lo, hi, page_lo, page_hi, chord, drawn (cable arc where known), meters, source.
    """
    linked = consecutive(poles).where("next_number IS NOT NULL").select(
        "route_id", F.col("number").alias("lo"), F.col("next_number").alias("hi"), F.col("page").alias("page_lo"), F.col("next_page").alias("page_hi"),
        dist2d("x", "y", "next_x", "next_y").alias("chord"))
    rows = linked.join(spans.select("route_id", "lo", "hi", "meters", "source"), ["route_id", "lo", "hi"], "left")
    if arcs is None:
        return rows.withColumn("drawn", F.col("chord"))
    rows = rows.join(arcs.select("route_id", F.col("number").alias("lo"), "arc_pt"), ["route_id", "lo"], "left")
    return rows.withColumn("drawn", F.coalesce("arc_pt", "chord")).drop("arc_pt")


def _with_next(rows: DataFrame) -> DataFrame:
    around = F.struct("meters", "drawn", "page_lo", "page_hi")
    return ordered_scan(rows, "route_id", "lo", chunk=number_chunk("lo"), lag={"_p": around}, lead={"_n": around})


# Drawn over straight length of a corner span and of one with heavy detours; straight length over a
# neighbour's drawn length of a squeezed span.
CORNER_RATIO, HEAVY_RATIO, SQUEEZED_RATIO = 1.15, 1.25, 0.55


def impute_spans(rows: DataFrame, skip: Column | None = None) -> DataFrame:
    """Fill same-page N→N+1 spans from the neighbouring labels, scaled by drawn length, left to right.

    A filled value feeds the next span. rows: span_rows output plus tap (either end off the route cable). Spans where
    `skip` holds are left alone. Result: route_id, lo, meters, filled.
    """
    skip = F.lit(False) if skip is None else skip
    open_span = (F.col("page_lo") == F.col("page_hi")) & (F.col("hi") == F.col("lo") + 1) & (F.col("drawn") >= 1e-6) & ~F.coalesce(skip, F.lit(False))
    ready = _with_next(rows)
    next_same = F.col("_n.page_lo") == F.col("_n.page_hi")
    out_m = F.when(F.col("_n.meters") > 0, F.col("_n.meters"))
    corner = ~next_same & (F.col("chord") > 1e-6) & (F.col("drawn") / F.col("chord") > CORNER_RATIO)
    est_out = F.when(next_same & (F.col("_n.drawn") > 1e-6), out_m * F.col("drawn") / F.col("_n.drawn")).when(corner, out_m)
    in_ratio = F.when((F.col("_p.page_lo") == F.col("_p.page_hi")) & (F.col("_p.drawn") > 1e-6), F.col("drawn") / F.col("_p.drawn"))
    in_pt, out_pt = F.when(in_ratio.isNotNull(), F.col("_p.drawn")), F.when(next_same & (F.col("_n.drawn") > 1e-6) & (out_m > 0), F.col("_n.drawn"))
    heavy = (F.col("chord") > 1e-6) & (F.col("drawn") / F.col("chord") > HEAVY_RATIO)
    ready = ready.select("route_id", "lo", "meters", open_span.alias("fill"), est_out.alias("est_out"), in_ratio.alias("in_ratio"), out_m.alias("out_m"),
                         heavy.alias("heavy"), F.col("chord").alias("chord"), in_pt.alias("in_pt"), out_pt.alias("out_pt"),
                         F.coalesce(F.col("tap"), F.lit(False)).alias("tap"))

    def step(state, row):
        in_m = F.when(state["m"] > 0, state["m"])
        est_in = in_m * row["in_ratio"]
        squeezed = row["chord"] / F.least(F.when(in_m > 0, row["in_pt"]), row["out_pt"]) < SQUEEZED_RATIO
        mean = (in_m + row["out_m"]) / 2
        blend = F.greatest(est_in, row["est_out"], mean, F.when(row["tap"], est_in + row["est_out"]))
        both = est_in.isNotNull() & row["est_out"].isNotNull() & (row["heavy"] | F.coalesce(squeezed, F.lit(False)))
        guess = F.when(both, blend).otherwise(F.coalesce(row["est_out"], est_in))
        filled = ~F.coalesce(row["meters"] > 0, F.lit(False)) & row["fill"] & F.coalesce(guess > 0, F.lit(False))
        return F.struct(F.when(filled, guess).otherwise(row["meters"]).alias("m"), filled.alias("filled"))

    return chunked_fold(ready, "route_id", "lo", fields=[c for c in ready.columns if c not in ("route_id", "lo")],
                        zero=F.struct(F.lit(None).cast("double").alias("m"), F.lit(False).alias("filled")), step=step,
                        emit=lambda s, r: F.struct(r["lo"].alias("lo"), s["m"].alias("meters"), s["filled"].alias("filled")))


def impute_cross_page(rows: DataFrame) -> DataFrame:
    """Fill page-crossing spans with the mean of the neighbouring labels, left to right: route_id, lo, meters, filled."""
    ready = _with_next(rows).select("route_id", "lo", "meters", (F.col("page_lo") != F.col("page_hi")).alias("cross"), F.col("_n.meters").alias("out_m"))

    def step(state, row):
        a, b = F.when(state["m"] > 0, state["m"]), F.when(row["out_m"] > 0, row["out_m"])
        mean = F.coalesce((a + b) / 2, a, b)
        filled = ~F.coalesce(row["meters"] > 0, F.lit(False)) & row["cross"] & mean.isNotNull()
        return F.struct(F.when(filled, mean).otherwise(row["meters"]).alias("m"), filled.alias("filled"))

    return chunked_fold(ready, "route_id", "lo", fields=["meters", "cross", "out_m"],
                        zero=F.struct(F.lit(None).cast("double").alias("m"), F.lit(False).alias("filled")), step=step,
                        emit=lambda s, r: F.struct(r["lo"].alias("lo"), s["m"].alias("meters"), s["filled"].alias("filled")))


def prefill_gaps(rows: DataFrame, tap_geometry: DataFrame) -> DataFrame:
    """impute_spans, except tombstoned and bifurcation spans; a filled span out of a tap pole gets the short-leg length.

    tap_geometry: (route_id, number) of tap poles. New values carry source gap-prefill.
    """
    frozen = F.col("source").isin("jumpback-suppressed", "bifurcation-cleared", "bifurcation-tap", "bifurcation-main")
    taps = tap_geometry.select("route_id", F.col("number").alias("lo"), F.lit(True).alias("_tl"))
    marked = rows.join(taps, ["route_id", "lo"], "left").join(taps.select("route_id", F.col("lo").alias("hi"), F.col("_tl").alias("_th")), ["route_id", "hi"], "left")
    marked = marked.withColumn("tap", F.coalesce("_tl", F.lit(False)) | F.coalesce("_th", F.lit(False)))
    filled = impute_spans(marked, frozen)
    full = marked.drop("meters").join(filled, ["route_id", "lo"])
    seen = ordered_scan(full, "route_id", "lo", chunk=number_chunk("lo"), lag={"_p": F.struct("meters", "drawn", "page_lo", "page_hi")})
    squeeze = F.col("chord") / F.col("_p.drawn")
    est = (F.col("_p.meters") * squeeze + F.col("meters") * F.col("chord") / F.col("drawn")) / 2
    boost = F.least(F.lit(3.0), F.greatest(F.lit(1.75), 0.45 / squeeze))
    short = F.least(est * boost, (F.col("_p.meters") + F.col("meters")) / 2 * 0.35)
    use = (F.col("filled") & F.coalesce("_tl", F.lit(False)) & (F.col("_p.page_lo") == F.col("page_hi")) & (F.col("_p.meters") > 0) & (F.col("chord") > 0) & (squeeze < 0.28))
    return seen.select("route_id", "lo", "hi", F.when(F.coalesce(use, F.lit(False)), short).otherwise(F.col("meters")).alias("meters"),
                       F.when(F.col("filled"), "gap-prefill").otherwise(F.col("source")).alias("source"))


def chain_sum(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Label sum between two poles over consecutive spans, null when a hop is unlabelled; and the sum of what is there.

    pairs: route_id, src, dst (src < dst). Prefix sums over N→N+1 spans, then two equi-joins.
    """
    good = F.col("meters") > 0
    steps = spans.where("hi = lo + 1").groupBy("route_id", "lo").agg(F.max(F.when(good, F.col("meters"))).alias("_m"))
    summed = ordered_scan(steps.withColumn("_has", F.when(F.col("_m").isNotNull(), 1).otherwise(0)), "route_id", "lo",
                          chunk=number_chunk("lo"), cumsum={"_s": F.coalesce("_m", F.lit(0.0)), "_k": "_has"})
    before = summed.select("route_id", F.col("lo").alias("src"), (F.col("_s") - F.coalesce("_m", F.lit(0.0))).alias("_s0"), (F.col("_k") - F.col("_has")).alias("_k0"))
    upto = summed.select("route_id", (F.col("lo") + 1).alias("dst"), F.col("_s").alias("_s1"), F.col("_k").alias("_k1"))
    rows = pairs.join(before, ["route_id", "src"], "left").join(upto, ["route_id", "dst"], "left")
    n, total = F.col("_k1") - F.col("_k0"), F.col("_s1") - F.col("_s0")
    return rows.select(*pairs.columns, F.when(n == F.col("dst") - F.col("src"), total).alias("chain_m"), F.when(n > 0, total).alias("partial_m"))


def hop_metres(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """Length of a hop that may skip poles: the direct label, else the sum of the labels between."""
    direct = spans.where(F.col("meters") > 0).groupBy("route_id", F.col("lo").alias("src"), F.col("hi").alias("dst")).agg(F.max("meters").alias("_d"))
    rows = chain_sum(spans, pairs).join(direct, ["route_id", "src", "dst"], "left")
    return rows.select(*pairs.columns, F.coalesce("_d", "partial_m").alias("hop_m"))


def next_hop_label(spans: DataFrame, poles: DataFrame) -> DataFrame:
    """Label of the hop N→N+1. Where that is a tap leg: the label after the tap, else the main label less the leg."""
    best = spans.where(F.col("meters") > 0).groupBy("route_id", "lo", "hi").agg(
        F.max("meters").alias("m"), F.bool_or(F.coalesce(F.col("source") == "bifurcation-tap", F.lit(False))).alias("tap"))
    near = best.where("hi = lo + 1").select("route_id", F.col("lo").alias("number"), "m", "tap")
    after = near.select("route_id", (F.col("number") - 1).alias("number"), F.col("m").alias("_after"))
    main = best.where("hi = lo + 2").select("route_id", F.col("lo").alias("number"), F.col("m").alias("_main"))
    rows = poles.select("route_id", "number").join(near, ["route_id", "number"]).join(after, ["route_id", "number"], "left").join(main, ["route_id", "number"], "left")
    rest = F.when(F.col("_main") > F.col("m"), F.greatest(F.col("_main") - F.col("m"), 2 * span_tolerance("_main")))
    return rows.select("route_id", "number", F.when(F.col("tap"), F.coalesce("_after", rest, "m")).otherwise(F.col("m")).alias("label"))


# ---------------------------------------------------------------- positions

def interpolate_uncalibrated(poles: DataFrame, pages: DataFrame) -> DataFrame:
    """Move poles on uncalibrated pages onto a calibrated neighbour's page: the middle of the two neighbours when both
    share a page, else the position unchanged. A moved pole counts as calibrated for the next one.

    pages: (route_id, page) calibrated. Result: route_id, number, page, x, y, moved.
    """
    known = pages.select("route_id", "page", F.lit(True).alias("_ok")).distinct()
    rows = poles.join(known, PAGE, "left").withColumn("ok", F.coalesce("_ok", F.lit(False))).drop("_ok")
    ready = ordered_scan(rows, "route_id", "number", chunk=number_chunk(), lead={"nxt": F.struct("number", "page", "x", "y", "ok")})

    def step(s, r):
        prev_ok = F.coalesce(s["ok"] & (s["number"] == r["number"] - 1), F.lit(False))
        next_ok = F.coalesce(r["nxt"]["ok"] & (r["nxt"]["number"] == r["number"] + 1), F.lit(False))
        both = ~r["ok"] & prev_ok & next_ok & F.coalesce(s["page"] == r["nxt"]["page"], F.lit(False))
        page = F.when(r["ok"], r["page"]).when(prev_ok, s["page"]).when(next_ok, r["nxt"]["page"]).otherwise(r["page"])
        mid = lambda c: F.when(both, (s[c] + r["nxt"][c]) / 2).otherwise(r[c])
        moved = F.when(r["ok"], "no").when(both, "interpolated").when(prev_ok | next_ok, "reassigned").otherwise("stuck")
        return F.struct(r["number"].alias("number"), page.alias("page"), mid("x").alias("x"), mid("y").alias("y"),
                        (r["ok"] | prev_ok | next_ok).alias("ok"), moved.alias("moved"))

    zero = F.struct(F.lit(None).cast("int").alias("number"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("x"),
                    F.lit(None).cast("double").alias("y"), F.lit(False).alias("ok"), F.lit("no").alias("moved"))
    return chunked_fold(ready, "route_id", "number", fields=["page", "x", "y", "ok", "nxt"], zero=zero, step=step,
                        emit=lambda s, r: F.struct(*[s[c].alias(c) for c in ("number", "page", "x", "y", "moved")]))


def _neighbour_labels(poles: DataFrame, spans: DataFrame) -> DataFrame:
    active = spans.where((F.col("meters") > 0) & (F.col("hi") == F.col("lo") + 1)).groupBy("route_id", "lo").agg(F.max("meters").alias("_m"))
    into = active.select("route_id", (F.col("lo") + 1).alias("number"), F.col("_m").alias("m_in"))
    out = active.select("route_id", F.col("lo").alias("number"), F.col("_m").alias("m_out"))
    return poles.join(into, ["route_id", "number"], "left").join(out, ["route_id", "number"], "left")


def _shifted(poles: DataFrame, shift: int, columns, prefix: str) -> DataFrame:
    return poles.select("route_id", (F.col("number") + shift).alias("number"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def bracket_snap(poles: DataFrame, spans: DataFrame) -> DataFrame:
    """Move a pole onto the line of its neighbours, split by the two labels, where a chord misfits its label.

    One round against the input positions: route_id, number, x, y, snapped.
    """
    rows = (_neighbour_labels(poles, spans).join(_shifted(poles, 1, ("x", "y"), "p"), ["route_id", "number"], "left")
            .join(_shifted(poles, -1, ("x", "y"), "n"), ["route_id", "number"], "left"))
    c_in, c_out = dist2d("px", "py", "x", "y"), dist2d("x", "y", "nx", "ny")
    ratio = lambda c, m: F.when(c > 0.5, c / m).otherwise(0.0)
    off = lambda c, m: (F.abs(c - m) >= BRACKET_MISFIT_M) | (ratio(c, m) < 1 / BRACKET_RATIO) | (ratio(c, m) > BRACKET_RATIO)
    f = F.col("m_in") / (F.col("m_in") + F.col("m_out"))
    sx, sy = F.col("px") + f * (F.col("nx") - F.col("px")), F.col("py") + f * (F.col("ny") - F.col("py"))
    whole = dist2d("px", "py", "nx", "ny")
    new_err = F.abs(f * whole - F.col("m_in")) + F.abs((1 - f) * whole - F.col("m_out"))
    old_err = F.abs(c_in - F.col("m_in")) + F.abs(c_out - F.col("m_out"))
    move = F.coalesce((off(c_in, F.col("m_in")) | off(c_out, F.col("m_out"))) & (dist2d("x", "y", sx, sy) >= BRACKET_MOVE_PT) & (new_err < old_err), F.lit(False))
    return rows.select("route_id", "number", F.when(move, sx).otherwise(F.col("x")).alias("x"), F.when(move, sy).otherwise(F.col("y")).alias("y"), move.alias("snapped"))


def worst_adjacent_error(poles: DataFrame, spans: DataFrame) -> DataFrame:
    """Largest label error of the two spans at a pole, in metres; null when neither is labelled."""
    rows = (_neighbour_labels(poles, spans).join(_shifted(poles, 1, ("lat", "lon"), "p"), ["route_id", "number"], "left")
            .join(_shifted(poles, -1, ("lat", "lon"), "n"), ["route_id", "number"], "left"))
    a = F.abs(haversine_m("plat", "plon", "lat", "lon") - F.col("m_in"))
    b = F.abs(haversine_m("lat", "lon", "nlat", "nlon") - F.col("m_out"))
    return rows.select("route_id", "number", F.greatest(a, b).alias("worst_m"))


def expected_arc(poles: DataFrame, spans: DataFrame, hits: DataFrame, scale: DataFrame, direction: DataFrame) -> DataFrame:
    """Arc position each pole should have: the first pole's arc plus the labels so far, per page.

    scale and direction: per (route_id, page). Unlabelled steps add nothing.
    """
    active = spans.where((F.col("meters") > 0) & (F.col("hi") == F.col("lo") + 1)).groupBy("route_id", "lo").agg(F.max("meters").alias("_m"))
    into = active.select("route_id", (F.col("lo") + 1).alias("number"), "_m")
    seen = ordered_scan(poles.select(*PAGE, "number"), PAGE, "number", chunk=number_chunk(), lag={"_prev": "number"})
    step = F.when(F.col("_prev") == F.col("number") - 1, F.coalesce("_m", F.lit(0.0))).otherwise(0.0)
    rows = seen.join(into, ["route_id", "number"], "left").withColumn("_step", step)
    summed = ordered_scan(rows, PAGE, "number", chunk=number_chunk(), cumsum={"_cum": "_step"})
    start = hits.groupBy(*PAGE).agg(F.min_by("t", "number").alias("_t0"))
    out = summed.join(start, PAGE).join(scale, PAGE).join(direction, PAGE)
    return out.select(*PAGE, "number", (F.col("_t0") + F.col("direction") * F.col("_cum") / F.col("scale")).alias("expected_t"))


def arc_residual(hits: DataFrame, spans: DataFrame, scale: DataFrame) -> DataFrame:
    """Mean misfit of cable arcs to labels per run of consecutive numbers, as numbered and with the run mirrored.

    hits: route_id, page, number, t. Result: route_id, page, run, lo, hi, n, forward, mirrored.
    """
    runs = number_runs(hits.select(*PAGE, "number", "t"))
    ends = runs.groupBy(*PAGE, "run").agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.count("*").alias("n"))
    nxt = runs.select(*PAGE, "run", (F.col("number") - 1).alias("number"), F.col("t").alias("_t1"))
    steps = runs.join(nxt, [*PAGE, "run", "number"]).join(ends, [*PAGE, "run"]).join(scale, PAGE)
    steps = steps.withColumns({"_arc": F.abs(F.col("_t1") - F.col("t")) * F.col("scale"), "_mirror": F.col("lo") + F.col("hi") - F.col("number") - 1})
    active = spans.where((F.col("meters") > 0) & (F.col("hi") == F.col("lo") + 1)).groupBy("route_id", F.col("lo").alias("_at")).agg(F.max("meters").alias("_m"))
    label = lambda at, name: active.select("route_id", F.col("_at").alias(at), F.col("_m").alias(name))
    rows = steps.join(label("number", "_fm"), ["route_id", "number"], "left").join(label("_mirror", "_mm"), ["route_id", "_mirror"], "left")
    sums = rows.groupBy(*PAGE, "run").agg(F.avg(F.abs(F.col("_arc") - F.col("_fm"))).alias("forward"), F.avg(F.abs(F.col("_arc") - F.col("_mm"))).alias("mirrored"))
    return ends.join(sums, [*PAGE, "run"], "left")


def mirror_numbers(hits: DataFrame, spans: DataFrame, scale: DataFrame, max_residual: float = 20.0, gain: float = 6.0) -> DataFrame:
    """Reverse a run's numbers where labels fit the reversed order clearly better: adds new_number."""
    fit = arc_residual(hits, spans, scale)
    flip = (F.col("n") >= 3) & (F.col("mirrored") + gain < F.col("forward")) & (F.col("mirrored") <= max_residual)
    rows = number_runs(hits).join(fit.select(*PAGE, "run", "lo", "hi", F.coalesce(flip, F.lit(False)).alias("flipped")), [*PAGE, "run"])
    return rows.withColumn("new_number", F.when(F.col("flipped"), F.col("lo") + F.col("hi") - F.col("number")).otherwise(F.col("number"))).drop("lo", "hi")


# ---------------------------------------------------------------- ordering

def reading_order(markers: DataFrame, gap: float = COLUMN_PT) -> DataFrame:
    """Add pos: 1-based order by page, column (x gaps above 10 pt start a new one), y, id. markers: mark_id, page, x, y."""
    seen = ordered_scan(markers, PAGE, ["x", "mark_id"], chunk=F.floor(F.col("x") / 256), lag={"_px": "x"})
    opens = F.when(F.col("_px").isNull() | (F.col("x") - F.col("_px") > gap), F.col("x"))
    columns = ordered_scan(seen.withColumn("_open", opens), PAGE, ["x", "mark_id"], chunk=F.floor(F.col("x") / 256), cummax={"_column": "_open"})
    order = ["page", "_column", "y", "mark_id"]
    columns = checkpoint(columns)
    return (ordered_scan(columns, "route_id", order, chunk=F.struct("page", "_column"), cumsum={"pos": F.lit(1)})
            .drop("_px", "_open", "_column"))


def route_order(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """Number markers 1..N along each page's principal axis, pages in order. markers: mark_id, page, x, y.

    entries: (route_id, page, entry_x, entry_y), where the cable enters; a page is reversed when its last marker is
    nearer the entry than its first, or, without an entry, when the last lies clearly right of the first. Positions
    along the axis are binned to columns of 10 pt.
    """
    axis = principal_axis(markers, PAGE)
    along = F.col("x") * F.col("ux") + F.col("y") * F.col("uy")
    rows = markers.join(axis, PAGE).withColumn("_bin", F.floor(along / COLUMN_PT))
    spot, key = F.struct("x", "y"), F.struct("_bin", "y", "mark_id")
    ends = rows.groupBy(*PAGE).agg(F.min_by(spot, key).alias("_f"), F.max_by(spot, key).alias("_l")).join(entries, PAGE, "left")
    nearer = dist2d("_l.x", "_l.y", "entry_x", "entry_y") < dist2d("_f.x", "_f.y", "entry_x", "entry_y")
    turn = F.coalesce(nearer, F.col("_l.x") - F.col("_f.x") > COLUMN_PT)
    sign = F.when(F.col("_turn"), -1).otherwise(1)
    rows = rows.join(ends.select(*PAGE, turn.alias("_turn")), PAGE)
    rows = rows.withColumns({"_k1": F.col("_bin") * sign, "_k2": F.col("y") * sign, "_k3": F.col("mark_id") * sign})
    out = ordered_scan(rows, "route_id", ["page", "_k1", "_k2", "_k3"], chunk=F.struct("page", F.floor(F.col("_k1") / 16)), cumsum={"number": F.lit(1)})
    return out.select("route_id", "mark_id", "page", "x", "y", "number")


def route_key(poles: DataFrame) -> DataFrame:
    """Add key: projection on the chord from the page's lowest-numbered pole to its highest."""
    spot = F.struct("x", "y")
    ends = poles.groupBy(*PAGE).agg(F.min_by(spot, "number").alias("_f"), F.max_by(spot, "number").alias("_l"))
    dx, dy = F.col("_l.x") - F.col("_f.x"), F.col("_l.y") - F.col("_f.y")
    length = F.sqrt(dx * dx + dy * dy)
    ux, uy = F.when(length < 1e-6, 1.0).otherwise(dx / length), F.when(length < 1e-6, 0.0).otherwise(dy / length)
    return poles.join(ends, PAGE).withColumn("key", F.col("x") * ux + F.col("y") * uy).drop("_f", "_l")


def order_violations(keyed: DataFrame, candidates: DataFrame, tol: float = 12.0) -> DataFrame:
    """Add violates: a candidate key outside the span of its neighbours' keys by more than tol.

    candidates: route_id, page, number, cand_key. Neighbours are poles N-1 and N+1 on the page.
    """
    side = lambda shift, name: keyed.select(*PAGE, (F.col("number") + shift).alias("number"), F.col("key").alias(name))
    rows = (candidates.join(side(1, "_p"), [*PAGE, "number"], "left").join(side(-1, "_n"), [*PAGE, "number"], "left")
            .join(keyed.select(*PAGE, "number", F.col("key").alias("_own")), [*PAGE, "number"], "left"))
    low, high = F.least("_p", "_n"), F.greatest("_p", "_n")
    c = F.col("cand_key")
    inner = (c < low - tol) | (c > high + tol)
    rising = F.col("_own") <= F.col("_n")
    head = F.when(rising, c > F.col("_n") + tol).otherwise(c < F.col("_n") - tol)
    bad = F.when(F.col("_p").isNotNull(), inner).when(F.col("_n").isNotNull(), head).otherwise(False)
    return rows.withColumn("violates", bad).drop("_p", "_n", "_own")


def chord_neighbours(poles: DataFrame) -> DataFrame:
    """Nearest earlier and later pole of the page that is not auxiliary: adds left_number, right_number.

    poles: route_id, page, number, is_tap.
    """
    main = F.when(~F.col("is_tap"), F.col("number"))
    return ordered_scan(poles, PAGE, "number", chunk=number_chunk(), last={"left_number": main}, following={"right_number": main})
