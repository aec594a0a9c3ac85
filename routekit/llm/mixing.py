"""Mixing sources to target weights by entropy balancing.

Every document of a source gets the rate that is nearest, in entropy, to one copy while the rates times the sizes of the
source's documents add up to its target and no rate is above CAP. The solution tilts the rates exponentially by size,
min(CAP, exp(l * size / scale)), with one multiplier l per source: the root of the gradient of a convex dual. All roots are
found together by Newton steps inside brackets; a step is one aggregation over the table of distinct (source, size), which
holds all that the dual depends on. Sums are of decimals, so that any order of adding gives the same bits.

Rates become copies per (source, size): documents times rate, up or down at random (by hash) with the chance of the
fraction. What a source then misses or has too much is made up by one copy of some sizes: first of those rounded the wrong
way, then of any, from the largest down as long as they fit, again for the sizes that still fit what is left, which at least
halves it every time. So no size differs from its rates by two copies, and a source misses its target by less than the
smallest size that can change. Within one size, copies go evenly; the documents with the smallest hashes get the odd ones.
Groups of one source and size are ranked in SLICES slices.

Targets share all words among the sources by weight, at most CAP times a source's own words each; the excess goes to the
others by weight until none is above (a common level, found by rounds over the table of sources).

Cases: a null text has size 0 and its document one copy of nothing; null is the last of the sources; a source without words
has target 0; rows with a null id, and rows that repeat an id, are mixed each for itself; equal rows may get different numbers
of copies, in no matter which order; an empty table gives an empty result; other columns are left alone.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routekit.llm.common import query, table, words
from routekit.operators.core import checkpoint, ordered_scan, release, union_all

WEIGHTS, CAP = (1, 2, 3), 3
SLICES = 1024
EXACT = "decimal(38,6)"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mark, size, hash, slice); `mark` is the source without nulls."""
    source = F.col("source").cast("string")
    rows = docs.select("doc_id", source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("mark"),
                       F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("hash"))
    return rows.withColumn("slice", F.pmod("hash", F.lit(SLICES)).cast("int"))


def weighted(sources: DataFrame, weights) -> DataFrame:
    """Adds `weight`: the weights in turn, over the sources in code point order, null last."""
    order = F.col("source").asc_nulls_last()
    placed = checkpoint(sources.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = placed.groupBy("_part").count().select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    turn = F.pmod(rank, F.lit(len(weights)))
    return placed.join(before, "_part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).drop("_part", "_before")


def targets(classes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(mark, source_size, scale, target) per source."""
    words_of = F.sum(F.col("size") * F.col("n"))
    sources = checkpoint(weighted(classes.groupBy("mark").agg(F.first("source").alias("source"), words_of.alias("source_size"), F.max("size").alias("scale")), weights))
    whole, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (whole / weight if weight else 0.0), -1
    while True:
        above = cap * F.col("source_size") <= F.col("weight") * F.lit(level)
        n, held, rest = sources.agg(F.count_if(above), F.sum(F.when(above, cap * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not rest:
            break
        full, level = n, (whole - (held or 0)) / rest
    target = F.least((cap * F.col("source_size")).cast("double"), F.col("weight") * F.lit(float(level)))
    return sources.select("mark", "source_size", F.greatest("scale", F.lit(1)).cast("double").alias("scale"), target.alias("target"))


def rate(cap: int) -> Column:
    return F.when(F.col("full"), F.lit(float(cap))).otherwise(F.exp(F.least(F.col("l") * F.col("size") / F.col("scale"), F.lit(math.log(cap)))))


def newton(state: DataFrame, classes: DataFrame, cap: int) -> DataFrame:
    """One step for every source that is not settled; each keeps its bracket (low, high)."""
    tilt = F.col("l") * F.col("size") / F.col("scale")
    mass = F.col("n") * F.col("size") * rate(cap)
    slope = F.when(tilt < math.log(cap), mass * F.col("size") / F.col("scale")).otherwise(0.0)
    found = classes.join(state.where("NOT settled").select("mark", "l", "scale", "full"), "mark").groupBy("mark").agg(F.sum(mass.cast(EXACT)).cast("double").alias("_mass"), F.sum(slope.cast(EXACT)).cast("double").alias("_slope"))
    miss = F.col("_mass") - F.col("target")
    step = F.when(F.col("_slope") > 0, F.col("l") - F.col("_miss") / F.col("_slope"))
    inside = step.isNotNull() & (step > F.coalesce("low", F.lit(-math.inf))) & (step < F.coalesce("high", F.lit(math.inf)))
    reach = F.greatest(F.lit(1.0), F.abs("l"))
    other = F.when(F.col("low").isNull(), F.col("l") - reach).when(F.col("high").isNull(), F.col("l") + reach).otherwise((F.col("low") + F.col("high")) / 2)
    near = (F.abs("_miss") <= F.col("target") * 1e-7) | (F.col("high") - F.col("low") <= F.lit(1e-13) * reach)
    moved = state.join(found, "mark", "left").withColumn("_miss", miss)
    moved = moved.withColumns({"low": F.when(F.col("_miss") < 0, F.col("l")).otherwise(F.col("low")), "high": F.when(F.col("_miss") > 0, F.col("l")).otherwise(F.col("high"))})
    moved = moved.withColumn("settled", F.col("settled") | F.coalesce(near, F.lit(False)))
    return moved.withColumn("l", F.when(F.col("settled"), F.col("l")).when(inside, step).otherwise(other)).select(*state.columns)


def balanced(classes: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """`sources` with the multiplier l; `full` where the target is all that the cap allows."""
    full = F.col("target") >= cap * F.col("source_size")
    start = F.when(full | (F.col("target") <= 0), 0.0).otherwise(F.log(F.col("target") / F.col("source_size")))
    null = F.lit(None).cast("double")
    state = checkpoint(sources.withColumns({"full": full, "l": start, "low": null, "high": null, "settled": full | (F.col("source_size") == 0)}))
    while not state.where("NOT settled").isEmpty():
        after = checkpoint(newton(state, classes, cap))
        release(state)
        state = after
    return state.drop("low", "high", "settled")


def rounded(classes: DataFrame, cap: int = CAP) -> DataFrame:
    """(mark, size, n, copies): whole copies of every (source, size), from rows with `rate` and `target`."""
    ideal = F.col("n") * F.col("rate")
    chance = F.pmod(F.xxhash64("mark", "size"), F.lit(1 << 30)) / float(1 << 30)
    down = F.least(cap * F.col("n"), F.floor(ideal + 1e-6))
    rows = classes.withColumn("_down", down).withColumn("_part", F.greatest(ideal - F.col("_down"), F.lit(0.0)))
    rows = rows.withColumn("_side", F.when((F.col("_part") <= 1e-6) | (F.col("_down") >= cap * F.col("n")) | (F.col("size") == 0), 0).when(chance < F.col("_part"), -1).otherwise(1))  # what may be added
    rows = checkpoint(rows.withColumn("copies", F.col("_down") + F.when(F.col("_side") < 0, 1).otherwise(0)).drop("_down", "_part"))
    left = rows.groupBy("mark").agg((F.round(F.max("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("left")).where("left <> 0")
    changed = []
    for fair in (True, False):
        sided = rows.join(left, "mark").withColumn("_step", F.signum("left").cast("int"))
        room = F.when(F.col("_step") > 0, F.col("copies") < cap * F.col("n")).otherwise(F.col("copies") > 0)
        may = sided.where(F.col("_side") == F.col("_step") if fair else (F.col("size") > 0) & room)
        may = checkpoint((may if fair or not changed else may.join(union_all(changed), ["mark", "size"], "left_anti")).select("mark", "size", "left", "_step"))
        while not may.isEmpty():
            fits = may.withColumn("_order", -F.col("size")).where("size <= abs(left)")
            upto = ordered_scan(fits, "mark", "_order", chunk=F.floor(F.col("_order") / 4096), cumsum={"_sum": "size"})
            took = checkpoint(upto.where("_sum <= abs(left)").select("mark", "size", "_step"))
            if took.isEmpty():
                break
            changed.append(took)
            used = took.groupBy("mark").agg(F.sum(F.col("size") * F.col("_step")).alias("_used"))
            may = checkpoint(may.join(took, ["mark", "size"], "left_anti").join(used, "mark").withColumn("left", F.col("left") - F.col("_used")).where("left <> 0").drop("_used"))
        if fair and changed:
            used = union_all(changed).groupBy("mark").agg(F.sum(F.col("size") * F.col("_step")).alias("_used"))
            left = left.join(used, "mark", "left").select("mark", (F.col("left") - F.coalesce("_used", F.lit(0))).alias("left")).where("left <> 0")
    rows = rows.drop("_side")
    if not changed:
        return rows
    return rows.join(union_all(changed), ["mark", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("_step", F.lit(0))).drop("_step")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate) for every row of `docs`."""
    rows = checkpoint(sized(docs))
    cells = checkpoint(rows.groupBy("mark", "size", "slice").agg(F.first("source").alias("source"), F.count("*").alias("n")))
    classes = checkpoint(cells.groupBy("mark", "size").agg(F.first("source").alias("source"), F.sum("n").alias("n")))
    sources = balanced(classes, targets(classes, weights, cap), cap)
    tilted = classes.drop("source").join(sources, "mark").withColumn("rate", rate(cap)).drop("l", "full", "scale")
    plan = checkpoint(rounded(tilted, cap))
    start = F.sum("n").over(Window.partitionBy("mark", "size").orderBy("slice")) - F.col("n")  # at most SLICES rows
    dealt = cells.select("mark", "size", "slice", start.alias("_start")).join(plan.withColumnRenamed("n", "_n"), ["mark", "size"])
    placed = rows.join(dealt, ["mark", "size", "slice"])
    place = F.col("_start") + F.row_number().over(Window.partitionBy("mark", "size", "slice").orderBy("hash", "doc_id"))
    copies = F.floor(F.col("copies") / F.col("_n")) + F.when(place <= F.col("copies") % F.col("_n"), 1).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "rate")


@query("op11_mixing")
def op11(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
