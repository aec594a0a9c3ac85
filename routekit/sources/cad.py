"""CAD exchange text: group-code/value line pairs to entities, edges and extents.

A line in code position opens a pair if it is a number, ends the file if it is empty, and is skipped otherwise; the line after
a code is its value, whatever it holds. So every line that is not a number leaves code position behind it: a split knows
its place in the pairs from its first such line on, and a stray line costs no more than its own pair. One pass over the
splits, without a shuffle of lines, forms the entities that lie inside a split. Each split also gives what it can't tell
alone: its first lines, the pairs before its first and from its last entity head, its section changes, and its end (code or
value position, or stopped). Ends compose over the splits of a file: a split of numbers only flips the position by their
count, any other sets it. With that, the loose pairs of all splits become entities by running scans.

`at` orders the lines of a file: split offset plus line number in the split, which stays below the next split's offset.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routekit.operators.core import checkpoint, ordered_scan

# Layers read from the drawing.
POLE_LAYER = "Poste"
CABLE_LAYERS = {"TrechoSecundarioAereo": "secondary", "TrechoPrimarioAereo": "primary"}
_CHUNK = 1 << 20
CARRY = 50_000  # pairs of an open entity that a task holds; longer entities become loose pairs
NUMBER = r"^[+-]?[0-9]+"
REAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
SCAN = "file string, split long, at long, kind string, code int, value string, type string, layer string, block string, entity long, x double, y double, section string, numbers long, synced boolean, empty boolean"
FIELDS = [f.split()[0] for f in SCAN.split(", ")]
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(name, ARROW[kind]) for name, kind in (f.split() for f in SCAN.split(", "))])
CODE, VALUE, STOPPED = 0, 1, 2


def number_of(line: str) -> int:
    """The group code that a line begins with; -1, which means nothing, where it is too long for one."""
    found = re.match(NUMBER, line)[0]
    return int(found) if len(found) < 10 else -1


def reals(values: pa.Array) -> np.ndarray:
    """The numbers that values begin with, NaN where they don't."""
    try:
        return np.asarray(pc.cast(values, pa.float64()))
    except pa.ArrowInvalid:
        found = (re.match(REAL, v) for v in values.to_pylist())
        return np.array([float(m[0]) if m else np.nan for m in found])


def column(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind, from_pandas=True)


def last_at(mask: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Per row the last row up to it where mask holds, -1 where that lies before `floor`."""
    at = np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))
    return np.where(at >= floor, at, -1)


class Split:
    """Reads the lines of one split, batch by batch, into rows of SCAN."""

    def __init__(self, file: str, offset: int):
        self.file, self.offset, self.line = file, offset, 0
        self.state, self.synced, self.numbers, self.empty = CODE, offset == 0, 0, False
        self.code, self.section, self.inside = None, None, False
        self.pairs = self._pairs([], [], [])
        self.out: list[pa.RecordBatch] = []

    @staticmethod
    def _pairs(at, code, value):
        return np.asarray(at, dtype=np.int64), np.asarray(code, dtype=np.int64), pa.array(value, pa.string())

    def emit(self, kind: str, n: int, **columns):
        if n:
            full = {"file": [self.file] * n, "split": np.full(n, self.offset), "kind": [kind] * n} | columns
            self.out.append(pa.RecordBatch.from_arrays([column(full[f.name], f.type) if f.name in full else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA))

    def loose(self, at, code, value):
        self.emit("pair", len(at), at=at, code=code, value=value)

    def feed(self, lines: pa.Array):
        lines = pc.utf8_trim_whitespace(lines)
        start, self.line = self.line, self.line + len(lines)
        if self.state == STOPPED:
            return
        number = np.asarray(pc.match_substring_regex(lines, NUMBER))
        at = np.arange(start, start + len(lines)) + self.offset
        if not self.synced:
            first = int(np.argmin(number)) if not number.all() else len(number)
            head = min(first + 1, len(number))
            self.emit("line", head, at=at[:head], value=lines.slice(0, head))
            self.numbers += first
            if first == len(number):
                self.code = (int(at[-1]), number_of(lines[-1].as_py())) if len(at) else self.code
                return
            self.synced, self.empty, self.code = True, lines[first].as_py() == "", None
            lines, number, at = lines.slice(head), number[head:], at[head:]
        if not len(at):
            return
        before = np.concatenate([[self.state], self.state + np.cumsum(number)])  # numbers before each line
        other = np.maximum.accumulate(np.where(~number, np.arange(len(number)), -1))
        since = np.concatenate([[-1], other[:-1]])
        place = (before[:-1] - np.where(since >= 0, before[np.maximum(since, 0) + 1], 0)) % 2
        ends = np.flatnonzero((place == CODE) & (np.asarray(pc.utf8_length(lines)) == 0))
        stop = int(ends[0]) if len(ends) else len(at)
        opens = np.flatnonzero((place[:stop] == CODE) & number[:stop])
        codes = np.array([number_of(c) for c in lines.take(pa.array(opens)).to_pylist()], dtype=np.int64)
        values, places = opens + 1, at[opens]
        if self.code is not None and self.state == VALUE:  # the code stands in the batch before
            codes, values, places = np.concatenate([[self.code[1]], codes]), np.concatenate([[0], values]), np.concatenate([[self.code[0]], places])
        self.state = STOPPED if len(ends) else (VALUE if len(values) and values[-1] == len(at) else CODE)
        self.code = (int(places[-1]), int(codes[-1])) if self.state == VALUE else None
        whole = values < stop
        self.add(places[whole], codes[whole], lines.take(pa.array(values[whole])))

    def add(self, at, code, value):
        at, code, value = np.concatenate([self.pairs[0], at]), np.concatenate([self.pairs[1], code]), pa.concat_arrays([self.pairs[2], value.combine_chunks() if isinstance(value, pa.ChunkedArray) else value])
        heads = np.flatnonzero(code == 0)
        if not self.inside:  # pairs of an entity that began before
            n = int(heads[0]) if len(heads) else len(code)
            self.loose(at[:n], code[:n], value.slice(0, n))
            at, code, value, heads = at[n:], code[n:], value.slice(n), heads - n
        self.inside = self.inside or len(heads) > 0
        if len(heads) > 1:
            n = int(heads[-1])
            self.entities(at[:n], code[:n], value.slice(0, n), heads[:-1])
            at, code, value = at[n:], code[n:], value.slice(n)
        if len(code) > CARRY and value[0].as_py() != "SECTION":
            self.loose(at, code, value)
            at, code, value, self.inside = at[:0], code[:0], value.slice(0, 0), False
        self.pairs = at, code, value

    def entities(self, at, code, value, heads):
        """Rows of whole entities; each begins at one of `heads`."""
        kinds = value.take(pa.array(heads))
        after = np.append(heads[1:], len(code))
        change = np.flatnonzero(np.asarray(pc.is_in(kinds, pa.array(["SECTION", "ENDSEC"]))))
        follow = np.minimum(heads[change] + 1, len(code) - 1)
        named = np.asarray(pc.equal(kinds, "SECTION"))[change] & (after[change] > heads[change] + 1) & (code[follow] == 2)
        names = np.where(named, np.array(value.take(pa.array(follow)).to_pylist(), dtype=object), "")
        self.emit("section", len(change), at=at[heads[change]], section=names)
        for k in change[names == "HEADER"]:
            self.header(*(v[heads[k]:after[k]] for v in (at, code)), value.slice(heads[k], after[k] - heads[k]))
        known = np.concatenate([[self.section], names]).astype(object)
        sections = known[np.searchsorted(change, np.arange(len(heads)), side="right")]
        self.section = known[-1]
        of = np.searchsorted(heads, np.arange(len(code)), side="right") - 1
        for kind, rows in (("INSERT", self.inserts), ("LWPOLYLINE", self.polylines)):
            pick = np.flatnonzero(np.asarray(pc.equal(kinds, kind))[of])
            if len(pick):
                rows(at[pick], code[pick], value.take(pa.array(pick)), at[heads[of[pick]]], sections[of[pick]])

    def header(self, at, code, value):
        name = last_at(code == 9, np.zeros(len(code)))
        pick = np.flatnonzero((name >= 0) & np.isin(code, (10, 20)))
        self.emit("extent", len(pick), at=at[pick], code=code[pick], value=value.take(pa.array(name[pick])), x=reals(value.take(pa.array(pick))))

    @staticmethod
    def _first(entity):
        return np.maximum.accumulate(np.where(np.diff(entity, prepend=-1) != 0, np.arange(len(entity)), 0))

    def inserts(self, at, code, value, entity, section):
        first = self._first(entity)
        layer = last_at(code == 8, first)
        pole = (layer >= 0) & np.asarray(pc.equal(value, POLE_LAYER))[layer]
        ends = np.flatnonzero(np.diff(entity, append=-1) != 0)
        last = lambda c: last_at(pole & (code == c), first)[ends]
        name, x, y = last(2), last(10), last(20)
        fine = pole[ends] & (x >= 0) & (y >= 0)
        ends, name, x, y = ends[fine], name[fine], x[fine], y[fine]
        names = [v if k >= 0 else "unknown" for v, k in zip(value.take(pa.array(np.maximum(name, 0))).to_pylist(), name)]
        self.emit("entity", len(ends), at=at[x], type=["INSERT"] * len(ends), layer=[POLE_LAYER] * len(ends), block=names, entity=entity[ends],
                  x=reals(value.take(pa.array(x))), y=reals(value.take(pa.array(y))), section=section[ends])

    def polylines(self, at, code, value, entity, section):
        first = self._first(entity)
        layer = last_at((code == 8) & np.asarray(pc.is_in(value, pa.array(list(CABLE_LAYERS)))), first)
        ends = np.flatnonzero(np.diff(entity, append=-1) != 0)
        final = layer[ends][np.searchsorted(ends, np.arange(len(code)))]
        vertex = (code == 10) & (layer >= 0)
        owner = last_at(vertex, first)
        places = np.flatnonzero(vertex)
        y = np.full(len(code), -1)
        of_y = np.flatnonzero((code == 20) & (owner >= 0))
        y[owner[of_y]] = of_y  # the last one of a vertex stays
        found = y[places]
        ys = np.where(found >= 0, reals(value.take(pa.array(np.where(found >= 0, found, places)))), np.nan)
        self.emit("entity", len(places), at=at[places], type=["LWPOLYLINE"] * len(places), layer=value.take(pa.array(final[places])), entity=entity[places],
                  x=reals(value.take(pa.array(places))), y=ys, section=section[places])

    def close(self):
        self.loose(*self.pairs)
        self.emit("end", 1, at=[self.offset + self.line], code=[self.code[1] if self.code else None], numbers=[self.numbers], synced=[self.synced], empty=[self.empty], entity=[self.state])
        return self.out


def scan(spark: SparkSession, paths) -> DataFrame:
    """One row per vertex, loose pair, first line, section change, header value and split end."""
    def work(batches):
        split = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, offset = batch.column("file"), batch.column("split").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(offset) | np.asarray(pc.not_equal(file[1:], file[:-1])).astype(int)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                here = (file[low].as_py(), int(offset[low]))
                if split is None or (split.file, split.offset) != here:
                    if split:
                        yield from split.close()
                    split = Split(*here)
                split.feed(batch.column("line").slice(low, high - low))
                yield from split.out
                split.out = []
        if split:
            yield from split.close()

    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
    return lines.mapInArrow(work, SCAN)


def real(value) -> Column:
    return F.regexp_extract(value, REAL, 0).try_cast("double")


def split_starts(found: DataFrame) -> DataFrame:
    """(file, split, start, pending, stop): position in the pairs at the start of every split, the code of the split before
    it that waits for a value, and the place from which nothing counts any more."""
    order = Window.partitionBy("file").orderBy("split")  # a row per split
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = found.where("kind = 'end'").select("file", "split", "at", "code", "numbers", "synced", "empty", F.col("entity").alias("state"))
    flips = F.sum(F.when(~F.col("synced"), F.col("numbers")).otherwise(0)).over(before)
    rows = ends.withColumns({"_flips": F.coalesce(flips, F.lit(0)), "_upto": F.sum(F.when(~F.col("synced"), F.col("numbers")).otherwise(0)).over(order)})
    rows = rows.withColumn("_known", F.last(F.when(F.col("synced"), F.struct("state", F.col("_upto").alias("flips"))), ignorenulls=True).over(before))
    start = F.pmod(F.coalesce("_known.state", F.lit(CODE)) + F.col("_flips") - F.coalesce("_known.flips", F.lit(0)), F.lit(2))
    rows = rows.withColumn("start", start).withColumn("pending", F.lag("code").over(order))
    head = F.col("empty") & (F.pmod(F.col("start") + F.col("numbers"), F.lit(2)) == CODE)
    stop = F.when(head, F.col("split") + F.col("numbers")).when(F.col("state") == STOPPED, F.col("at"))
    return rows.withColumn("stop", F.min(stop).over(Window.partitionBy("file"))).select("file", "split", "start", "pending", "stop")


def loose_pairs(found: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, split, at, code, value): the pairs of no whole entity, those of the first lines of splits among them."""
    in_split = Window.partitionBy("file", "split").orderBy("at")
    lines = found.where("kind = 'line'").select("file", "split", "at", "value").join(starts, ["file", "split"])
    numbered = lines.withColumns({"_n": F.row_number().over(in_split) - 1, "_before": F.lag("value").over(in_split)})
    code = F.when(F.col("_n") == 0, F.col("pending")).otherwise(F.regexp_extract("_before", NUMBER, 0).try_cast("int"))
    first = numbered.where(F.pmod(F.col("start") + F.col("_n"), F.lit(2)) == VALUE).select("file", "split", "at", code.alias("code"), "value", "stop")
    rest = found.where("kind = 'pair'").select("file", "split", "at", "code", "value").join(starts.select("file", "split", "stop"), ["file", "split"])
    return first.unionByName(rest).where("code IS NOT NULL AND (stop IS NULL OR at < stop)").drop("stop")


def resolved(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(scan rows with known sections, pairs of cut entities: file, entity, type, section, name, at, code, value)."""
    found = checkpoint(scan(spark, paths))
    starts = checkpoint(split_starts(found))
    pairs = loose_pairs(found, starts)
    own = F.when(F.col("code") == 0, F.struct(F.col("at").alias("entity"), F.col("value").alias("type")))
    chunk = F.floor(F.col("at") / _CHUNK)
    headed = ordered_scan(pairs.withColumn("_own", own), "file", "at", chunk=chunk, last={"_before": "_own"}, lead={"_next": F.struct("code", "value", "at")})
    headed = headed.withColumn("_head", F.coalesce("_own", "_before")).where("_head IS NOT NULL")
    pairs = checkpoint(headed.select("file", "split", "at", "code", "value", "_head.entity", "_head.type", F.when((F.col("_next.code") == 2) & (F.col("code") == 0), F.col("_next.value")).alias("name")))
    changes = pairs.where("code = 0 AND type IN ('SECTION', 'ENDSEC')").select("file", "split", "at", F.when(F.col("type") == "SECTION", F.coalesce("name", F.lit(""))).otherwise("").alias("section"))
    # the section in which a split's own entities begin: the last change before the first of them
    inner = found.where("kind = 'section'").select("file", "split", "at", "section")
    first = found.where("kind IN ('section', 'entity')").groupBy("file", "split").agg(F.min(F.coalesce("entity", "at")).alias("at")).withColumn("section", F.lit(None).cast("string"))
    events = changes.unionByName(inner).withColumn("_first", F.lit(False)).unionByName(first.withColumn("_first", F.lit(True)))
    begins = ordered_scan(events, "file", ["at", "_first"], chunk=chunk, last={"_section": "section"}).where("_first").select("file", "split", F.coalesce("_section", F.lit("")).alias("_section"))
    rows = found.where("kind IN ('entity', 'extent')").join(starts.select("file", "split", "stop"), ["file", "split"]).where("stop IS NULL OR at < stop")
    rows = rows.join(begins, ["file", "split"], "left").withColumn("section", F.coalesce("section", "_section")).drop("_section", "stop")
    heads = pairs.where("code = 0").select("file", "at", "entity", F.lit(None).cast("string").alias("section"), F.lit(True).alias("_head"))
    marks = heads.unionByName(changes.unionByName(inner).select("file", "at", F.lit(None).cast("long").alias("entity"), "section", F.lit(False).alias("_head")))
    placed = ordered_scan(marks, "file", ["at", "_head"], chunk=chunk, last={"_section": "section"}).where("_head").select("file", "entity", F.coalesce("_section", F.lit("")).alias("section"))
    return rows, pairs.drop("split").join(placed, ["file", "entity"])


def cut_entities(pairs: DataFrame) -> DataFrame:
    """Entities that lie in several splits, from their pairs; a long polyline is scanned in chunks."""
    mine = pairs.where("section = 'ENTITIES' AND type IN ('INSERT', 'LWPOLYLINE')")
    layer = F.when(F.col("code") == 8, F.col("value"))
    cable = F.when((F.col("code") == 8) & F.col("value").isin(list(CABLE_LAYERS)), F.col("value"))
    vertex = F.when(F.col("code") == 10, F.col("at"))
    key = ["file", "entity"]
    rows = ordered_scan(mine.withColumns({"_l": layer, "_c": cable, "_v": vertex}), key, "at", chunk=F.floor(F.col("at") / _CHUNK), last={"_layer": "_l", "_cable": "_c", "_vertex": "_v"})
    rows = checkpoint(rows)
    last = lambda value, mask: F.max_by(value, F.when(mask, F.col("at")))
    pole = F.col("_layer") == POLE_LAYER
    at = lambda code: pole & (F.col("code") == code)
    inserts = rows.where("type = 'INSERT'").groupBy(*key).agg(F.max_by("_l", F.when(F.col("_l").isNotNull(), F.col("at"))).alias("layer"), F.coalesce(last(F.col("value"), at(2)), F.lit("unknown")).alias("block"),
                                                           last(F.col("at"), at(10)).alias("seq"), last(real("value"), at(10)).alias("x"), last(real("value"), at(20)).alias("y"))
    inserts = inserts.where(F.col("layer") == POLE_LAYER).select(*key, F.lit("INSERT").alias("type"), "layer", "block", "seq", "x", "y")
    lines = rows.where("type = 'LWPOLYLINE' AND code IN (8, 10, 20)")
    layers = lines.groupBy(*key).agg(F.max_by("_c", F.when(F.col("_c").isNotNull(), F.col("at"))).alias("layer"))
    points = lines.where("_cable IS NOT NULL AND (code = 10 OR _vertex IS NOT NULL)").where("code IN (10, 20)").withColumn("seq", F.when(F.col("code") == 10, F.col("at")).otherwise(F.col("_vertex")))
    points = points.groupBy(*key, "seq").agg(last(real("value"), F.col("code") == 10).alias("x"), last(real("value"), F.col("code") == 20).alias("y"), F.bool_or(F.col("code") == 10).alias("_own")).where("_own").drop("_own")
    vertices = points.join(layers.where("layer IS NOT NULL"), key).select(*key, F.lit("LWPOLYLINE").alias("type"), "layer", F.lit(None).cast("string").alias("block"), "seq", "x", "y")
    return inserts.unionByName(vertices)


def read_cad_text(spark: SparkSession, paths) -> DataFrame:
    """Pole inserts and cable polyline vertices of the ENTITIES section: entities(file, entity, type, layer, block, seq, x, y).

    An insert counts with its last block name, x and y that follow its layer; it needs both coordinates. A vertex begins at
    an x that follows a cable layer and takes the last y before the next; what isn't a number is null.
    """
    rows, pairs = resolved(spark, paths)
    whole = rows.where("kind = 'entity' AND section = 'ENTITIES'").select("file", "entity", "type", "layer", "block", F.col("at").alias("seq"), "x", "y")
    return whole.unionByName(cut_entities(pairs)).where("type = 'LWPOLYLINE' OR (x IS NOT NULL AND y IS NOT NULL)")


def pole_inserts(entities: DataFrame) -> DataFrame:
    return entities.where("type = 'INSERT'").select("file", "entity", "block", "x", "y")


def polyline_edges(entities: DataFrame, layers=None) -> DataFrame:
    """Edges between consecutive vertices of a polyline: file, poly, kind, ax, ay, bx, by."""
    layers = layers or CABLE_LAYERS
    pairs = [F.lit(p) for kv in layers.items() for p in kv]
    lines = entities.where("type = 'LWPOLYLINE'")
    linked = ordered_scan(lines, ["file", "entity"], "seq", chunk=F.floor(F.col("seq") / _CHUNK), lead={"_n": F.struct("x", "y")})
    return linked.where("_n IS NOT NULL").select("file", F.col("entity").alias("poly"), F.create_map(*pairs)[F.col("layer")].alias("kind"),
                                                 F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("_n.x").alias("bx"), F.col("_n.y").alias("by"))


def read_extents(spark: SparkSession, paths) -> DataFrame:
    """Header extents per file: min_x, min_y, max_x, max_y (0 where absent)."""
    rows, pairs = resolved(spark, paths)
    names = pairs.where("type = 'SECTION' AND code = 0 AND name = 'HEADER'").select("file", "entity")
    cut = ordered_scan(pairs.drop("section").join(names, ["file", "entity"]).withColumn("_n", F.when(F.col("code") == 9, F.col("value"))), ["file", "entity"], "at", chunk=F.floor(F.col("at") / _CHUNK), last={"_name": "_n"})
    at = rows.where("kind = 'extent'").select("file", "at", F.col("value").alias("name"), "code", "x").unionByName(
        cut.where("code IN (10, 20)").select("file", "at", F.col("_name").alias("name"), "code", real("value").alias("x")))
    pick = lambda name, code: F.coalesce(F.max_by("x", F.when((F.col("name") == name) & (F.col("code") == code), F.col("at"))), F.lit(0.0))
    return at.groupBy("file").agg(pick("$EXTMIN", 10).alias("min_x"), pick("$EXTMIN", 20).alias("min_y"), pick("$EXTMAX", 10).alias("max_x"), pick("$EXTMAX", 20).alias("max_y"))
