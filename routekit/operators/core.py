"""Shared physical patterns. Every one of them splits hot keys, so that no route, page or cell has to fit one task.

* ordered_scan   lag/lead/prefix sums/nearest known value over (key, order), cut into bounded chunks
* rank_values    exact order statistics by counting, not by collecting
* radius_pairs   grid-cell equi-join for "within r"
* nearest        exact nearest target by widening rings
* chunked_fold   sequential folds, a bounded chunk per task and round
"""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096
FOLD_CHUNK = 512


_LOCAL: dict[str, str] = {}


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir. Only a single-machine session (local master) may leave it unset; it then gets
    one temporary folder of its own, and the session's settings stay as they are. A cluster without it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[context.applicationId]


def scratch_path(spark, name: str = "routekit") -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write a table into the cluster's shared checkpoint folder and read it back.

    A written table survives lost executors, and unlike Dataset.checkpoint it carries no constraints from the plan
    before it, which would pile up over the rounds of a loop. Once it is written, the shuffle files of its job are
    dropped, so a chain of such steps needs the disk of its largest one, not of all.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def release(*written: DataFrame) -> None:
    """Delete tables that `checkpoint` wrote, once nothing will read them again."""
    for df in written:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else (value if isinstance(value, Column) else F.lit(value))


def number_chunk(number="number", width: int = CHUNK) -> Column:
    return F.floor(col(number) / width)


def value_chunk(value, width: float) -> Column:
    return F.floor(col(value) / width)


def ordered_scan(df: DataFrame, by, order, *, chunk: Column, lag=None, lead=None, cumsum=None, last=None, following=None,
                 cummax=None) -> DataFrame:
    """Window results over (by, order) without gathering a key in one task.

    `chunk` must be non-decreasing along `order`. Windows run inside (by, chunk); one summary row per chunk carries
    the border values across. Each option maps an output name to an input column:
    lag/lead: neighbour's value; cumsum: running total including the row; last/following: nearest non-null value
    strictly before/after; cummax: running maximum including the row.
    """
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if isinstance(order, str) else list(order)
    options = {k: v or {} for k, v in dict(lag=lag, lead=lead, cumsum=cumsum, last=last, following=following, cummax=cummax).items()}
    cut = df.withColumn("_chunk", chunk)
    key = F.struct(*[F.col(o) for o in order])
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    after = inside.rowsBetween(1, Window.unboundedFollowing)
    across = Window.partitionBy(*by).orderBy("_chunk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)

    local, summary, carry, final = {}, {}, {}, {}
    boxed = lambda c: F.struct(col(c).alias("v"))  # keeps a null neighbour apart from no neighbour

    def plan(kind, name, source, at, summarise, carry_over, combine):
        local[f"_l_{name}"] = at
        summary[f"_s_{name}"] = summarise
        carry[f"_c_{name}"] = carry_over(F.col(f"_s_{name}"))
        final[name] = combine(F.col(f"_l_{name}"), F.col(f"_c_{name}"))

    for name, source in options["lag"].items():
        plan("lag", name, source, F.lag(boxed(source)).over(inside), F.max_by(boxed(source), key),
             lambda s: F.lag(s).over(across), lambda a, b: F.coalesce(a, b)["v"])
    for name, source in options["lead"].items():
        plan("lead", name, source, F.lead(boxed(source)).over(inside), F.min_by(boxed(source), key),
             lambda s: F.lead(s).over(across), lambda a, b: F.coalesce(a, b)["v"])
    for name, source in options["cumsum"].items():
        plan("cumsum", name, source, F.sum(col(source)).over(upto), F.sum(col(source)),
             lambda s: F.sum(s).over(earlier),
             lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b))
    for name, source in options["last"].items():
        known = lambda c: F.when(col(c).isNotNull(), key)
        plan("last", name, source, F.last(col(source), ignorenulls=True).over(before),
             F.max_by(col(source), known(source)),
             lambda s: F.last(s, ignorenulls=True).over(earlier), lambda a, b: F.coalesce(a, b))
    for name, source in options["following"].items():
        known = lambda c: F.when(col(c).isNotNull(), key)
        plan("following", name, source, F.first(col(source), ignorenulls=True).over(after),
             F.min_by(col(source), known(source)),
             lambda s: F.first(s, ignorenulls=True).over(later), lambda a, b: F.coalesce(a, b))
    for name, source in options["cummax"].items():
        plan("cummax", name, source, F.max(col(source)).over(upto), F.max(col(source)),
             lambda s: F.max(s).over(earlier), lambda a, b: F.greatest(a, b))

    rows = cut.select("*", *[c.alias(n) for n, c in local.items()])
    borders = (cut.groupBy(*by, "_chunk").agg(*[c.alias(n) for n, c in summary.items()])
               .select(*by, "_chunk", *[c.alias(n) for n, c in carry.items()]))
    joined = rows.join(borders, [*by, "_chunk"], "left")
    return joined.select(*df.columns, *[c.alias(n) for n, c in final.items()])


def rank_values(df: DataFrame, by, value: str, ranks: dict, *, width: float) -> DataFrame:
    """Exact order statistics per key: one row (by..., n, <name>...).

    `ranks` maps a name to a function of the count column that gives a 1-based rank. Equal values are counted first;
    the running count uses ordered_scan over value ranges of `width`, so a hot key is split by value.
    """
    by = [by] if isinstance(by, str) else list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    totals = counted.groupBy(*by).agg(F.sum("_k").alias("n"))
    running = ordered_scan(counted, by, value, chunk=value_chunk(value, width), cumsum={"_upto": "_k"})
    joined = running.join(totals, by)
    hit = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_k") < rank)
    return (joined.groupBy(*by)
            .agg(F.first("n").alias("n"),
                 *[F.max(F.when(hit(rank(F.col("n"))), F.col(value))).alias(name) for name, rank in ranks.items()]))


def upper_median(n: Column) -> Column:
    return F.floor(n / 2) + 1


def lower_median(n: Column) -> Column:
    return F.floor((n + 1) / 2)


def nearest_rank_95(n: Column) -> Column:
    return F.ceil(n * F.lit(0.95))


def true_median(df: DataFrame, by, value: str, name: str, *, width: float) -> DataFrame:
    """(by..., n, name): mean of the two middle values."""
    picked = rank_values(df, by, value, {"_lo": lower_median, "_hi": upper_median}, width=width)
    by = [by] if isinstance(by, str) else list(by)
    return picked.select(*by, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


# ---------------------------------------------------------------- spatial joins

def cells(df: DataFrame, coords, size, halo: bool = False) -> DataFrame:
    """Add the grid cell _c0,_c1[,_c2] of the coordinates; with halo, one row per cell that `size` around them touches.

    A cell is two sizes wide, so a halo is two cells an axis, or three where the slack for rounding tips it over.
    """
    names = [f"_c{i}" for i in range(len(coords))]
    if not halo:
        return df.withColumns({n: F.floor(col(c) / (2 * size)) for n, c in zip(names, coords)})
    for name, c in zip(names, coords):
        edge = lambda sign: F.floor((col(c) + sign * 1.001 * size) / (2 * size))
        df = df.withColumn(name, F.explode(F.sequence(edge(-1), edge(1))))
    return df


def radius_pairs(left: DataFrame, right: DataFrame, radius, by=(), dims: int = 2) -> DataFrame:
    """Pairs within `radius`. left has (lid,lx,ly[,lz]), right has (rid,rx,ry[,rz]), both have `by`; adds d.

    An equi-join on the grid cell: each right row is offered to the cells it reaches, and a left row is in one cell only.
    """
    lc, rc = ["lx", "ly", "lz"][:dims], ["rx", "ry", "rz"][:dims]
    names = [f"_c{i}" for i in range(dims)]
    pairs = cells(left, lc, radius).join(cells(right, rc, radius, halo=True), [*by, *names])
    return pairs.withColumn("d", distance(lc, rc)).where(F.col("d") <= radius).drop(*names)


def real(*names: str) -> Column:
    """True where every named coordinate is a finite number; null, NaN and infinite places can be near nothing."""
    out = F.lit(True)
    for name in names:
        out = out & F.coalesce(F.abs(F.col(name)) < F.lit(float("inf")), F.lit(False))
    return out


SMALL = 1024  # pairs of a group that is settled in one go


def distance(left, right) -> Column:
    return F.sqrt(sum(((F.col(b) - F.col(a)) * (F.col(b) - F.col(a)) for a, b in zip(left, right)), F.lit(0.0)))


def _large_groups(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """(by...): the groups whose rows form more than SMALL pairs."""
    count = lambda df, n: df.groupBy(*by).agg(F.count("*").alias(n))
    return checkpoint(count(left, "_nl").join(count(right, "_nr"), by).where(F.col("_nl") * F.col("_nr") > SMALL).select(*by))


def nearest(left: DataFrame, right: DataFrame, by=(), *, start: float, limit: float | None = None, growth: int = 4,
            payload=(), dims: int = 2, slack: float = 0.0, refine=None) -> DataFrame:
    """Exact nearest right row for each left row (ties: smallest rid): by..., lid, d, rid, payload...

    Rings widen by `growth` from `start`: a left row with a hit inside the ring is final, the others go on to the next
    ring. With a `limit` the last ring is the limit itself, and rows without a hit are left out; without one, rings go
    on until every left row whose group has a target is served. Groups of at most SMALL pairs are joined whole at once. Dense places are settled in small cells, so no group
    is ever paired whole. Rows without a finite place on either side are left out. Extended targets (segment pieces) give `refine`, which adds the true d and payload to
    candidate rows, and the `slack` by which a target may reach nearer than its reference point.
    """
    by = list(by)
    refine = refine or (lambda pairs: pairs)
    lc, rc = ["lx", "ly", "lz"][:dims], ["rx", "ry", "rz"][:dims]
    targets = right.where(real(*rc))
    todo = left.select(*by, "lid", *lc).where(real(*lc))
    keep = lambda pairs: pairs if limit is None else pairs.where(F.col("d") <= limit)
    closest = lambda pairs: (pairs.groupBy(*by, "lid").agg(F.min(F.struct("d", "rid", *payload)).alias("_b")).select(*by, "lid", "_b.*"))
    done = []
    if limit is None or start < limit:  # every ring reads both sides
        todo = checkpoint(todo)
        targets = checkpoint(targets.join(todo.select(*by).distinct(), by, "left_semi") if by else targets)
        if by:
            large = _large_groups(todo, targets, by)
            some = not large.isEmpty()
            small = (todo.join(large, by, "left_anti") if some else todo).join(targets, by)
            done.append(closest(keep(refine(small.withColumn("d", distance(lc, rc))))))
            if not some:
                return done[0]
            todo, targets = checkpoint(todo.join(large, by, "left_semi")), checkpoint(targets.join(large, by, "left_semi"))
    if limit is None:
        todo = todo.join(targets.select(*by).distinct(), by, "left_semi") if by else todo.where(F.lit(not targets.isEmpty()))
    radius, first = float(start), True
    while True:
        last_ring = limit is not None and radius >= limit
        radius = limit if last_ring else radius
        if by and not first:  # a group whose rows are all settled offers no more targets
            targets = targets.join(todo.select(*by).distinct(), by, "left_semi")
        first = False
        pairs = refine(radius_pairs(todo, targets, radius + slack, by, dims)).where(F.col("d") <= radius)
        best = closest(pairs)
        if last_ring:
            done.append(best)
            break
        best = checkpoint(best)
        done.append(best)
        todo = checkpoint(todo.join(best.select(*by, "lid"), [*by, "lid"], "left_anti"))
        if todo.isEmpty():
            break
        radius *= growth
    return union_all(done)


def knn(left: DataFrame, right: DataFrame, k: int, by=(), *, start: float, growth: int = 4) -> DataFrame:
    """Exact k nearest right rows of each left row, ties by rid: by..., lid, rid, d, rank (1-based).

    Rings as in nearest: a left row is final once its ring holds k targets, or all targets of its group. Rows without a
    finite place on either side are left out.
    """
    by = list(by)
    targets = right.select(*by, "rid", "rx", "ry").where(real("rx", "ry"))
    todo = left.select(*by, "lid", "lx", "ly").where(real("lx", "ly"))
    if by:
        todo = todo.join(targets.groupBy(*by).agg(F.least(F.count("*"), F.lit(k)).alias("_need")), by)
    else:
        found = targets.count()
        todo = todo.withColumn("_need", F.lit(min(k, found))).where(F.lit(found > 0))
    done, radius = [], float(start)
    order = Window.partitionBy(*by, "lid").orderBy("d", "rid")
    while True:
        ranked = radius_pairs(todo, targets, radius, by).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = checkpoint(ranked.select(*by, "lid", "rid", "d", "rank", "_need"))
        full = ranked.where(F.col("rank") == F.col("_need")).select(*by, "lid")
        done.append(ranked.join(full, [*by, "lid"], "left_semi").drop("_need"))
        todo = checkpoint(todo.join(full, [*by, "lid"], "left_anti"))
        if todo.isEmpty():
            return union_all(done)
        radius *= growth


def union_all(parts) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- assignment

def _greedy_small(candidates: DataFrame, by) -> DataFrame:
    """greedy_pairs for groups of at most SMALL candidates: one sorted list a group, walked once."""
    order = ["cost", "lid", "rid"]
    rest = [c for c in candidates.columns if c not in (*by, *order)]
    listed = candidates.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_p"))
    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("lid", "rid")}
    none = lambda c: F.array().cast(f"array<{kinds[c]}>")
    free = lambda acc, p: ~F.array_contains(acc["l"], p["lid"]) & ~F.array_contains(acc["r"], p["rid"])
    take = lambda acc, p: F.struct(F.array_append(acc["l"], p["lid"]).alias("l"), F.array_append(acc["r"], p["rid"]).alias("r"))
    kind = f"struct<l:array<{kinds['lid']}>,r:array<{kinds['rid']}>>"
    taken = F.aggregate("_p", F.struct(none("lid").alias("l"), none("rid").alias("r")).cast(kind), lambda acc, p: F.when(free(acc, p), take(acc, p).cast(kind)).otherwise(acc))
    won = listed.select(*by, "_p", taken.alias("_t")).select(*by, F.explode(F.filter("_p", lambda p: F.get("_t.r", F.array_position("_t.l", p["lid"]).cast("int") - 1) == p["rid"])).alias("_w"))
    return won.select(*by, "_w.*").select(*candidates.columns)


def greedy_pairs(candidates: DataFrame, by=(), left_rank=("cost", "lid", "rid"), right_rank=("cost", "lid", "rid")) -> DataFrame:
    """One-to-one matching that equals taking candidate pairs in ascending (cost, lid, rid) order.

    A pair that is the best of both its ends is always the next greedy choice for them, so all such pairs are accepted
    at once and the rest goes another round. candidates: by..., lid, rid, cost, plus payload. Other ranks give other
    stable matchings, for example lefts served in id order. Groups of few candidates are settled without rounds.
    """
    by = list(by)
    open_pairs, accepted = checkpoint(candidates), []
    if by and left_rank == right_rank == ("cost", "lid", "rid"):
        large = checkpoint(open_pairs.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL).select(*by))
        if large.isEmpty():
            return _greedy_small(open_pairs, by)
        accepted.append(_greedy_small(open_pairs.join(large, by, "left_anti"), by))
        open_pairs = checkpoint(open_pairs.join(large, by, "left_semi"))
    while not open_pairs.isEmpty():
        by_left = open_pairs.groupBy(*by, "lid").agg(F.min(F.struct(*left_rank)).alias("_k")).select(*by, "_k.lid", "_k.rid")
        by_right = open_pairs.groupBy(*by, "rid").agg(F.min(F.struct(*right_rank)).alias("_k")).select(*by, "_k.lid", "_k.rid")
        mutual = by_left.join(by_right, [*by, "lid", "rid"])
        won = checkpoint(open_pairs.join(mutual, [*by, "lid", "rid"], "left_semi"))
        accepted.append(won)
        open_pairs = checkpoint(open_pairs.join(won.select(*by, "lid"), [*by, "lid"], "left_anti")
                                .join(won.select(*by, "rid"), [*by, "rid"], "left_anti"))
    return union_all(accepted) if accepted else open_pairs


def _densest_cell(left: DataFrame, right: DataFrame, radius: float, by) -> int:
    """Largest number of pairs that one grid cell of lefts forms with the rights in and around it."""
    count = lambda df, c, n, halo: cells(df, c, radius, halo=halo).groupBy(*by, "_c0", "_c1").agg(F.count("*").alias(n))
    met = count(left, ["lx", "ly"], "_nl", False).join(count(right, ["rx", "ry"], "_nr", True), [*by, "_c0", "_c1"])
    return met.agg(F.max(F.col("_nl") * F.col("_nr"))).first()[0] or 0


def _match_piles(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """Zero-distance matches: points on one spot pair up in id order, by rank, without forming their product."""
    def ranked(df, i, x, y):
        spot = [*by, "_x", "_y"]
        placed = df.withColumns({"_x": F.col(x), "_y": F.col(y)})
        return ordered_scan(placed, spot, i, chunk=F.floor(F.col(i) / 65536), cumsum={"_rank": F.lit(1)}).select(*spot, "_rank", i)

    same = ranked(left, "lid", "lx", "ly").join(ranked(right, "rid", "rx", "ry"), [*by, "_x", "_y", "_rank"])
    return same.select(*by, "lid", "rid", F.lit(0.0).alias("d"))


def assign_1to1(left: DataFrame, right: DataFrame, by=(), *, max_d: float, dense: int = 100_000) -> DataFrame:
    """Greedy one-to-one nearest assignment within max_d: by..., lid, rid, d.

    Equal to taking all pairs in ascending (d, lid, rid). Points on one spot pair up by rank first, at distance zero. The
    rest goes through bands of growing radius: pairs of a smaller band always come before those of a larger one, so
    finishing a band first keeps the greedy order while crowded spots empty out before wider cells are paired. Bands are
    added below max_d until no cell forms more than `dense` pairs. Groups of at most SMALL pairs need neither cells nor
    bands: they are joined whole and settled in one go. Ids are numeric; rows without a finite place get none.
    """
    by = list(by)
    left, right = left.select(*by, "lid", "lx", "ly").where(real("lx", "ly")), right.select(*by, "rid", "rx", "ry").where(real("rx", "ry"))
    parts = []
    if by:
        left, right = checkpoint(left), checkpoint(right)
        large = _large_groups(left, right, by)
        some = not large.isEmpty()
        pairs = (left.join(large, by, "left_anti") if some else left).join(right, by).withColumn("cost", distance(["lx", "ly"], ["rx", "ry"])).where(F.col("cost") <= max_d)
        small = _greedy_small(pairs.select(*by, "lid", "rid", "cost"), by).select(*by, "lid", "rid", F.col("cost").alias("d"))
        if not some:
            return small
        parts.append(small)
        left, right = checkpoint(left.join(large, by, "left_semi")), checkpoint(right.join(large, by, "left_semi"))
    piles = checkpoint(_match_piles(left, right, by))
    bands = [float(max_d)]
    parts.append(piles)
    left = checkpoint(left.join(piles.select(*by, "lid"), [*by, "lid"], "left_anti"))
    right = checkpoint(right.join(piles.select(*by, "rid"), [*by, "rid"], "left_anti"))
    while bands[0] > 1e-9 * max_d and _densest_cell(left, right, bands[0], by) > dense:
        bands.insert(0, bands[0] / 4)
    for i, radius in enumerate(bands):
        pairs = radius_pairs(left, right, radius, by).select(*by, "lid", "rid", F.col("d").alias("cost"))
        won = greedy_pairs(pairs, by).select(*by, "lid", "rid", F.col("cost").alias("d"))
        parts.append(won)
        if i + 1 < len(bands):
            left = checkpoint(left.join(won.select(*by, "lid"), [*by, "lid"], "left_anti"))
            right = checkpoint(right.join(won.select(*by, "rid"), [*by, "rid"], "left_anti"))
    return union_all(parts)


# ---------------------------------------------------------------- sequential folds

def chunked_fold(df: DataFrame, by, order, *, fields, zero: Column, step, emit, width: int = FOLD_CHUNK,
                 chunk: Column | None = None) -> DataFrame:
    """Sequential fold over (by, order) that yields one output row per input row.

    Rows are collected per (by, chunk) only, so an array never exceeds a chunk. Chunks with the same position in
    their key are folded together; a longer key hands its state to the next round.
    zero: initial state; step(state, row) -> state; emit(state_after, row) -> struct with the output fields.
    """
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if isinstance(order, str) else list(order)
    chunk = number_chunk(order[0], width) if chunk is None else chunk
    grouped = (df.withColumn("_chunk", chunk)
               .groupBy(*by, "_chunk")
               .agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("_rows")))
    grouped = checkpoint(grouped)  # read twice below: once for the longest key, once for the fold
    position = F.row_number().over(Window.partitionBy(*by).orderBy("_chunk"))
    spread = grouped.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0

    def run(part, state):
        head = F.col("_rows")[0]
        shapes = part.select(step(state, head).alias("s"), emit(step(state, head), head).alias("e")).schema
        kind, item = shapes["s"].dataType.simpleString(), shapes["e"].dataType.simpleString()

        def advance(acc, row):
            after = step(acc["s"], row)
            return F.struct(after.cast(kind).alias("s"), F.concat(acc["o"], F.array(emit(after, row))).cast(f"array<{item}>").alias("o"))

        start = F.struct(state.cast(kind).alias("s"), F.array().cast(f"array<{item}>").alias("o"))
        return part.withColumn("_f", F.aggregate("_rows", start, advance))

    placed = checkpoint(grouped.withColumn("_pos", position))
    carried, outputs = None, []
    for at in range(1, max(1, spread) + 1):
        part = placed.where(F.col("_pos") == at)
        if carried is None:
            part = run(part, zero)
        else:
            part = run(part.join(carried, by), F.col("_s0"))
        part = checkpoint(part.select(*by, F.col("_f.o").alias("_o"), F.col("_f.s").alias("_s0")))
        outputs.append(part.select(*by, F.explode("_o").alias("_e")).select(*by, "_e.*"))
        carried = part.select(*by, "_s0")
    return union_all(outputs)
