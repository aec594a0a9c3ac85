"""Substring dedup: suffix automata of reference shards give the matching statistics of documents; long spans go.

A window is SPAN consecutive words. Words of a document that lie in a window found anywhere else (same document included)
are removed; windows are judged on the input. Words are compared as they are.

An automaton of a whole corpus fits no machine, and streaming every document through every shard is quadratic, so only
what can match is brought together. Each window has an anchor: the GRAM of its words with the smallest hash, the leftmost
of equals. Equal windows have equal anchors. The consecutive windows with one anchor are a passage; every window of a
document lies in exactly one.
* An anchor that occurs once settles its passage: nothing in it repeats.
* A passage that occurs twice or more as a whole is removed as a whole.
* The other passages of an anchor go, with one copy of each repeated passage, into a reference shard of bounded size. Its
  suffix automaton counts occurrences; every passage streams through it, and the longest match that occurs twice tells at
  each word which words to remove.
* An anchor with more than CROWD different passages (what surrounds a very common passage) would not fit a shard; its
  windows are counted by hash instead, which no hot key can slow down, and those that occur twice are removed.

Joins on an anchor or a window deal keys with many rows over several tasks (`spread_join`).

Cases: null texts have no words; texts shorter than a window lose nothing; repeated rows are occurrences of their own, so
they lose their windows; rows are told apart by a number of their own, so ids of any type may repeat, with equal or other
texts, or be null, and such rows count like all others; very long texts are handled a document at a time (the memory of
one text, some numbers a word); an empty table gives an empty result; other columns, whatever their names, are left out.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routekit.llm.common import documents, query
from routekit.operators.core import checkpoint, release

SPAN, GRAM, CROWD = 35, 8, 64
SHARD_PASSAGES = 1500
HOT_SHARE, HOT_LEAST, SALTS = 200, 10_000, 64
ODD = np.uint64(0x9E3779B97F4A7C15)  # any odd number


def powers(n: int, base: np.uint64 = ODD) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(found: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w, 42) for w in found]), ">u8").astype(np.uint64)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, sizes) -> np.ndarray:
    """A hash of hashes[start:start + size] that doesn't depend on the place."""
    scale = powers(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * scale[:-1], dtype=np.uint64)])
    back = powers(len(hashes) + 1, np.uint64(pow(int(ODD), -1, 1 << 64)))
    mixed = (sums[starts + sizes] - sums[starts]) * back[starts]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def passages(found: list[bytes], span: int = SPAN, gram: int = GRAM):
    """(anchor hash, passage hash, first window, windows) of the words of a text, as arrays."""
    n = len(found) - span + 1
    if n <= 0:
        return None
    hashes = word_hashes(found)
    grams = run_hashes(hashes, np.arange(len(found) - gram + 1), gram)
    value, place, width, need = grams, np.arange(len(grams)), 1, span - gram + 1
    while width < need:  # the smallest of ever wider runs, the left one of equals
        step = min(width, need - width)
        left = value[:-step] <= value[step:]
        value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
        width += step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    windows = np.diff(np.append(first, n))
    return grams[place[first]].view(np.int64), run_hashes(hashes, first, windows + span - 1).view(np.int64), first, windows


class Automaton:
    """Suffix automaton over integer sequences, with occurrence weights."""

    def __init__(self):
        self.next, self.link, self.size, self.seen, self.last = [{}], [-1], [0], [0], 0

    def add(self, symbol: int, weight: int) -> None:
        nexts, link, size = self.next, self.link, self.size
        new, at = len(size), self.last
        nexts.append({})
        link.append(0)
        size.append(size[at] + 1)
        self.seen.append(weight)
        while at >= 0 and symbol not in nexts[at]:
            nexts[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = nexts[at][symbol]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                twin = len(size)
                nexts.append(nexts[to].copy())
                link.append(link[to])
                size.append(size[at] + 1)
                self.seen.append(0)
                while at >= 0 and nexts[at].get(symbol) == to:
                    nexts[at][symbol] = twin
                    at = link[at]
                link[to] = link[new] = twin
        self.last = new

    def finish(self) -> None:
        for state in np.argsort(self.size)[:0:-1].tolist():
            self.seen[self.link[state]] += self.seen[state]

    def repeated_spans(self, symbols: list[int], span: int) -> list[tuple[int, int]]:
        """Maximal (from, to) runs in which every word ends or lies in a match of `span` symbols that occurs twice."""
        state = size = 0
        spans: list[list[int]] = []
        for at, symbol in enumerate(symbols):
            while True:
                to = self.next[state].get(symbol)
                if to is not None and self.seen[to] >= 2:
                    state, size = to, size + 1
                    break
                if state == 0:
                    size = 0
                    break
                state = self.link[state]
                size = self.size[state]
            if size >= span:
                begin = at + 1 - size
                if spans and begin <= spans[-1][1]:
                    spans[-1][1] = at + 1
                else:
                    spans.append([begin, at + 1])
        return [tuple(s) for s in spans]


def settle_shard(rows: pa.Table, span: int = SPAN) -> pa.Table:
    """(row, begin, end) removed from the single passages of a shard (row, first, copies, words)."""
    machine, symbols, kept, stop = Automaton(), {}, [], -1
    for row, first, copies, data in zip(*(rows[c].to_pylist() for c in ("row", "first", "copies", "words"))):
        ids = [symbols.setdefault(w, len(symbols)) for w in data.split()]
        for symbol in ids:
            machine.add(symbol, min(copies, 2))
        machine.add(stop, 0)  # a symbol that occurs nowhere else keeps passages apart
        stop -= 1
        if copies == 1:
            kept.append((row, first, ids))
    machine.finish()
    out = [(row, first + a, first + b) for row, first, ids in kept for a, b in machine.repeated_spans(ids, span)]
    return pa.table({name: pa.array([r[k] for r in out], pa.int64()) for k, name in enumerate(("row", "begin", "end"))})


def all_passages(docs: DataFrame) -> DataFrame:
    """(anchor, passage, row, first, windows) of all documents (row, text)."""
    names = ["anchor", "passage", "row", "first", "windows"]

    def run(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = passages(text.as_py().split())
                if found is not None:
                    anchor, passage, first, windows = found
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(passage), pa.array(np.full(len(first), row)), pa.array(first.astype(np.int64)), pa.array(windows.astype(np.int64))], names)

    whole = docs.where("row IS NOT NULL AND text IS NOT NULL").select("row", F.col("text").cast("binary"))
    return whole.mapInArrow(run, "anchor long, passage long, row long, first long, windows long")


def passage_words(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor, passage, row, first, copies, words, window): for a bounded anchor the words of each passage, for a crowded one its window hashes."""
    listed = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "passage", "first", "windows", "copies", "crowded")).alias("list"))

    def run(batches):
        for batch in batches:
            for row, text, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                found = text.as_py().split()
                hashes, out = None, []
                for r in items.as_py():
                    begin, n = r["first"], r["windows"]
                    if r["crowded"]:
                        hashes = word_hashes(found) if hashes is None else hashes
                        part = run_hashes(hashes[begin:begin + n + SPAN - 1], np.arange(n), SPAN).view(np.int64)
                        out += [(r["anchor"], begin + k, r["copies"], None, h) for k, h in enumerate(part.tolist())]
                    else:
                        out.append((r["anchor"], begin, r["copies"], b" ".join(found[begin:begin + n + SPAN - 1]), None))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(out), pa.int64()), *(pa.array(columns[k], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())))],
                                                 ["row", "anchor", "first", "copies", "words", "window"])

    joined = docs.join(listed, "row").select("row", F.col("text").cast("binary").alias("text"), "list")
    return joined.mapInArrow(run, "row long, anchor long, first long, copies long, words binary, window long")


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """`rows` (with row, first) joined with the written table `keys`, which has a row for each key and in `n` how many of
    `rows` hold it. A key with over a HOT_SHARE-th of them (there are fewer than HOT_SHARE such keys, so their hashes are
    constants of the plan) is dealt over SALTS tasks by its rows, and its one key row is repeated for each."""
    limit = max(HOT_LEAST, (keys.agg(F.sum(n)).first()[0] or 0) // HOT_SHARE)
    hot = [r[0] for r in keys.where(F.col(n) > limit).select(F.xxhash64(*on)).distinct().collect()]
    if not hot:
        return rows.join(keys.drop(n), on, how)
    crowded = F.xxhash64(*on).isin(hot)
    dealt = rows.withColumn("_salt", F.when(crowded, F.pmod(F.xxhash64("row", "first"), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = keys.drop(n).withColumn("_salt", F.explode(F.when(crowded, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def removed_spans(docs: DataFrame) -> DataFrame:
    """(row, begin, end) of `docs` (row, text): word positions that repeat elsewhere, ends excluded; spans may overlap."""
    found = checkpoint(all_passages(docs))  # read twice below
    anchors = checkpoint(found.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("passage") == F.max("passage")).alias("alike")).where("n > 1"))
    shared = checkpoint(spread_join(found, anchors, ["anchor"], "n"))
    release(found, anchors)
    span = lambda df: df.select("row", F.col("first").alias("begin"), (F.col("first") + F.col("windows") + (SPAN - 1)).alias("end"))
    unlike = shared.where("NOT alike")
    kinds = checkpoint(unlike.groupBy("anchor", "passage", "windows").agg(F.count("*").alias("copies"), F.min(F.struct("row", "first")).alias("at")))
    twice = span(spread_join(unlike, kinds.where("copies > 1").drop("at"), ["anchor", "passage", "windows"], "copies", "left_semi"))
    sizes = checkpoint(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).withColumn("crowded", F.col("kinds") > CROWD))
    wanted = checkpoint(spread_join(kinds.select("anchor", "passage", "windows", "copies", "at.*"), sizes, ["anchor"], "kinds"))
    passages_ = checkpoint(passage_words(wanted, docs))
    release(sizes, wanted)
    held = passages_.where("words IS NOT NULL")
    shards = max(1, -(-held.count() // SHARD_PASSAGES))
    settled = held.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"), "row", "first", "copies", "words").groupBy("shard").applyInArrow(
        lambda rows: settle_shard(rows), "row long, begin long, end long")
    windows = passages_.where("window IS NOT NULL").select("row", "first", "copies", "window", "anchor")
    often = checkpoint(windows.groupBy("anchor", "window").agg(F.sum("copies").alias("n")).where("n > 1"))
    counted = spread_join(windows.where("copies = 1"), often, ["anchor", "window"], "n", "left_semi").select("row", F.col("first").alias("begin"), (F.col("first") + SPAN).alias("end"))
    return span(shared.where("alike")).unionByName(twice).unionByName(settled).unionByName(counted)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): for every row of `docs` (doc_id, text) the words that stay, joined by one space.

    The numbered rows are written, so a task that runs again finds the same numbers."""
    numbered = checkpoint(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text")))
    spans = removed_spans(numbered.select("row", "text")).groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                found = (text.as_py() or b"").split()
                gone = np.zeros(len(found) + 1, np.int64)
                for s in spans.as_py() or ():
                    gone[s["begin"]] += 1
                    gone[s["end"]] -= 1
                stay = np.cumsum(gone[:-1]) == 0
                kept = found if stay.all() else [found[k] for k in np.flatnonzero(stay).tolist()]
                out.append((len(found), len(found) - len(kept), b" ".join(kept).decode(errors="replace")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return numbered.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, kind)


@query("op6_substring_dedup")
def op6(spark, sf_dir):
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
