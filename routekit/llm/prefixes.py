"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

A conversation is a path of turns; a node is a distinct sequence of first turns. Paths (128-bit digests of role and text, in
hex) are dealt to shards by range of (path, conv_id), so equal beginnings lie together and no first turn or conversation has
to fit one shard. A shard writes its trie as parentheses in the order of its sorted paths. `Parens` keeps the least excess of
every block in a tree: findclose skips the blocks that can't hold the partner, and with it a subtree is a range. Ranks of
opens count its nodes, ranks of leaf pairs "()" its leaves, and cumulative arrays over the opens give members and savings.

A node can lie in several shards only where it is on the first or last path of each (a spine). The shard after another one
shares the common beginning of the other's last path and its own first path; what these nodes counted twice there (their own
words, a leaf, a child) is taken off, and the rest adds up by node. All other nodes are finished in their shard.

Cases: a null role or text is empty; rows with a null conv_id belong to no conversation and are left out; rows of one
conversation with equal turns are ordered by digest, equal rows are turns of their own; a conversation without rebuilt turns
is a member of the root; without conversations there are no nodes; other columns are left alone. Of a conversation, digests
and word counts of its turns (some 50 bytes each, no texts) stand in one row, of very long texts only those.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routekit.llm.common import query, table, words
from routekit.operators.core import checkpoint, release

HEX = 32  # digits of a turn
GROUP, KEPT = 20, 4
SHARD_CONVS = 50_000
CHUNK = 4096  # ids of a row
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
ROWS = ("kind int, shard int, slot long, parent_slot long, on_first boolean, key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string, first binary, last binary, running array<long>")
INNER, SPINE, ENDS, BORDER = range(4)


class Parens:
    """A sequence of parentheses (1 opens) with the least excess of every block and of every pair of blocks above them."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int64)
        self.excess = np.cumsum(2 * self.bits - 1)
        blocks = max(1, -(-len(bits) // self.BLOCK))
        self.leaves = 1 << (blocks - 1).bit_length()
        held = np.full(self.leaves * self.BLOCK, np.iinfo(np.int64).max)
        held[:len(bits)] = self.excess
        self.least = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.least[self.leaves:] = held.reshape(self.leaves, self.BLOCK).min(axis=1)
        for k in range(self.leaves - 1, 0, -1):
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])
        self.padded = held
        self.opens = np.flatnonzero(self.bits)
        self.leaf_rank = np.concatenate([[0], np.cumsum((self.bits[:-1] == 1) & (self.bits[1:] == 0)), [0]])

    def _scan(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place from `at` to the end of its block with excess at most `target`, or -1."""
        out, todo = np.full(len(at), -1), np.arange(len(at))
        at = at.copy()
        while len(todo):
            hit = self.padded[at[todo]] <= target[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] % self.BLOCK != 0]
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The partner of each open."""
        target = self.excess[opens] - 1
        inside = (opens + 1) % self.BLOCK != 0
        out = np.full(len(opens), -1)
        out[inside] = self._scan(opens[inside] + 1, target[inside])
        far = np.flatnonzero(out < 0)
        node, aim = opens[far] // self.BLOCK + self.leaves, target[far]
        up = np.arange(len(far))
        while len(up):  # to the next block or group of blocks on the right, upwards where that begins a larger group
            step = node[up] + 1
            node[up] = step // (step & -step)
            up = up[self.least[node[up]] > aim[up]]
        down = np.flatnonzero(node < self.leaves)
        while len(down):
            child = 2 * node[down]
            node[down] = child + (self.least[child] > aim[down])
            down = down[node[down] < self.leaves]
        out[far] = self._scan((node - self.leaves) * self.BLOCK, aim)
        return out

    def subtrees(self) -> tuple[np.ndarray, np.ndarray]:
        """Per open, in order: the number of opens and of leaf pairs from it to its partner."""
        close = self.findclose(self.opens)
        return (close - self.opens + 1) // 2, self.leaf_rank[close] - self.leaf_rank[self.opens]


def shared(a: str, b: str) -> int:
    """The number of common first turns of two paths."""
    most = min(len(a), len(b)) // HEX
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle * HEX] == b[:middle * HEX] else (low, middle - 1)
    return low


def encode(rows: Iterable[tuple[int, str, list[int]]], shard: int) -> list[dict]:
    """Rows (conv_id, path, words per turn), sorted by path and id, as nodes: finished ones, spines, ids of cut groups, border."""
    depth, own, parent, least, ends, digest = [0], [0], [-1], [None], [0], [None]
    bits, stack, first, last, ids, cut = bytearray([1]), [0], None, None, [], []

    def finish(whole: bool) -> None:
        if whole:
            digest[stack[-1]] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        else:
            key = hashlib.md5(last.encode()).hexdigest()
            cut.extend({"kind": ENDS, "shard": shard, "depth": depth[stack[-1]], "key": key, "conv_id": ids[at], "ends_sha256": ",".join(map(str, ids[at:at + CHUNK]))} for at in range(0, len(ids), CHUNK))
        ids.clear()

    for conv, path, counts in rows:
        if path != last:
            if last is None:
                first, running = path, [0, *np.cumsum(counts, dtype=np.int64).tolist()] if len(counts) else [0]
            else:
                finish(last != first)
            keep = shared(path, last or "")
            while len(stack) > keep + 1:
                stack.pop()
                bits.append(0)
            for k in range(keep, len(counts)):
                depth.append(k + 1), own.append(counts[k]), parent.append(stack[-1]), least.append(None), ends.append(0), digest.append(None)
                stack.append(len(depth) - 1)
                bits.append(1)
            last = path
        tip = stack[-1]
        least[tip] = conv if least[tip] is None else min(least[tip], conv)
        ends[tip] += 1
        ids.append(conv)
    if last is None:
        return []
    finish(False)
    right = stack[:]
    bits.extend(bytes(len(stack)))
    for v in range(len(depth) - 1, 0, -1):
        up = parent[v]
        least[up] = least[v] if least[up] is None else min(least[up], least[v])
    size, leaves = Parens(np.frombuffer(bits, dtype=np.uint8)).subtrees()
    start = np.arange(len(depth))
    members_to = np.concatenate([[0], np.cumsum(ends)])
    members = members_to[start + size] - members_to[start]
    saved_to = np.concatenate([[0], np.cumsum((members - 1) * np.array(own, dtype=np.int64))])
    saved = saved_to[start + size] - saved_to[start]
    children = np.bincount(np.array(parent[1:], dtype=np.int64), minlength=len(depth)) if len(depth) > 1 else np.zeros(1, dtype=np.int64)

    keys = {}
    for path, nodes in ((first, range(len(first) // HEX + 1)), (last, right)):
        state = hashlib.md5()
        for k, v in enumerate(nodes):
            state.update(path[(k - 1) * HEX:k * HEX].encode() if k else b"")
            keys[v] = state.hexdigest()
    out = cut
    out.append({"kind": BORDER, "shard": shard, "first": bytes.fromhex(first), "last": bytes.fromhex(last), "running": running})
    on_first = len(first) // HEX
    for v in range(len(depth)):
        up = parent[v]
        row = {"conv_id": least[v], "depth": depth[v], "n_convs": int(members[v]), "n_children": int(children[v]), "n_leaves": int(leaves[v]), "saved_tokens": int(saved[v]), "shard": shard, "parent_slot": up if up in keys else -1}
        if v in keys:
            out.append(row | {"kind": SPINE, "slot": v, "key": keys[v], "on_first": v <= on_first, "ends_sha256": digest[v]})
        else:
            out.append(row | {"kind": INNER, "parent_conv_id": None if up in keys else least[up], "ends_sha256": digest[v] or NOBODY})
    return out


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation its turns in order, as (sig, words)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    sig = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"), sig.alias("sig"), F.size(words(text)).cast("long").alias("words")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(ordered.alias("_t")).select("conv_id", F.transform("_t", lambda t: F.struct(t["sig"].alias("sig"), t["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame, group: int = GROUP, kept: int = KEPT) -> DataFrame:
    """Every conversation with the first h turns of its group's first one in place of its own first h."""
    base = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, kept - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % kept).cast("int")
    joined = convs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).join(base, "_base", "left").withColumn("_h", h)
    head = F.slice(F.coalesce("_head", F.array().cast(convs.schema["turns"].dataType)), F.lit(1), F.col("_h"))
    tail = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


def whole_ends(chunks: DataFrame) -> DataFrame:
    """(depth, key, digest): chunks of ids in order, hashed one after the other."""
    def work(batches):
        at, state, out = None, None, []
        for batch in batches:
            for depth, key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "ids"))):
                if (depth, key) != at:
                    if at:
                        out.append((*at, state.hexdigest()))
                    at, state = (depth, key), hashlib.sha256(ids.encode())
                else:
                    state.update(("," + ids).encode())
        if at:
            out.append((*at, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["depth", "key", "digest"])

    return chunks.repartition("depth", "key").sortWithinPartitions("depth", "key", "conv_id").select("depth", "key", F.col("ends_sha256").alias("ids")).mapInArrow(work, "depth long, key string, digest string")


def common_turns(a: str, b: str) -> Column:
    """Common first turns of two binary columns."""
    n = HEX // 2
    least = f"least(length({a}), length({b})) div {n}"
    same = f"array_position(transform(sequence(1L, {least}), k -> substring({a}, cast((k - 1) * {n} + 1 as int), {n}) = substring({b}, cast((k - 1) * {n} + 1 as int), {n})), false)"
    return F.expr(f"CASE WHEN {least} = 0 THEN 0 WHEN {same} = 0 THEN {least} ELSE {same} - 1 END")


def merged(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spine nodes, their places (shard, slot)) from the rows of all shards."""
    borders = found.where(F.col("kind") == BORDER).select("shard", "first", "last", "running")
    turn = borders.select("shard", F.row_number().over(Window.orderBy("shard")).alias("_k"))  # a row per shard
    before = borders.join(turn, "shard").select((F.col("_k") + 1).alias("_k"), F.col("last").alias("_before"))
    common = common_turns("_before", "first")
    cut = borders.join(turn, "shard").join(before, "_k").select("shard", "running", common.alias("_common"), (F.length("_before") / (HEX // 2)).cast("long").alias("_tip"))
    spine = found.where(F.col("kind") == SPINE).select("shard", "slot", "parent_slot", "on_first", "key", *(c for c in NODE if c != "parent_conv_id"))
    again = F.col("on_first") & (F.col("depth") <= F.col("_common"))
    taken = lambda c: F.coalesce(F.when(again, c), F.lit(0)).cast("long")
    at = lambda k: F.get("running", k.cast("int"))
    spine = checkpoint(spine.join(cut, "shard", "left").withColumns({
        "saved_tokens": F.col("saved_tokens") + taken(at(F.col("_common")) - F.coalesce(at(F.col("depth") - 1), F.lit(0))),
        "n_leaves": F.col("n_leaves") - taken((F.col("_common") == F.col("_tip")).cast("long")),
        "n_children": F.col("n_children") - taken((F.col("depth") < F.col("_common")).cast("long"))}).drop("running", "_common", "_tip"))
    nodes = spine.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("_ends"), F.min(F.struct("shard", "parent_slot")).alias("_up"))
    ends = whole_ends(found.where(F.col("kind") == ENDS).select("depth", "key", "conv_id", "ends_sha256"))
    nodes = checkpoint(nodes.join(ends, ["depth", "key"], "left").withColumn("ends_sha256", F.coalesce("digest", "_ends", F.lit(NOBODY))).drop("digest", "_ends"))
    places = checkpoint(spine.select("shard", "slot", "depth", "key").join(nodes.select("depth", "key", F.col("conv_id").alias("parent_conv_id")), ["depth", "key"]).select("shard", "slot", "parent_conv_id"))
    release(spine)
    return nodes, places


def prefix_trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of conversations (conv_id, turns): the columns of NODE. `shards` is their number, by default by their size."""
    spark = convs.sparkSession
    rows = checkpoint(convs.select("conv_id", F.array_join(F.transform("turns", lambda t: t["sig"]), "").alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_CONVS))

    def work(batches):
        def read():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "words")))

        out = encode(read(), TaskContext.get().partitionId())
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_pylist(out[at:at + 10_000], schema=schema)

    empty = spark.createDataFrame([], ROWS)
    schema = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}[f.dataType.simpleString()]) for f in empty.schema])
    found = checkpoint(rows.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(work, ROWS))
    release(rows)
    nodes, places = merged(found)
    inner = found.where(F.col("kind") == INNER)
    done = inner.where("parent_slot < 0").select(*NODE)
    hung = inner.where("parent_slot >= 0").drop("slot", "parent_conv_id").join(places.withColumnRenamed("slot", "parent_slot"), ["shard", "parent_slot"]).select(*NODE)
    up = nodes.withColumns({"shard": F.col("_up.shard"), "slot": F.col("_up.parent_slot")})
    return done.unionByName(hung).unionByName(up.join(places, ["shard", "slot"], "left").select(*NODE))


# CRC-32 of the id's digits, bit by bit, and every node with all its ancestors
SQL = """
WITH own AS (
  SELECT conv_id, list({'there': turn IS NOT NULL, 'turn': turn, 'sig': md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (SELECT conv_id, t, list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(conv_id::VARCHAR, '')])) AS b FROM own),
head AS (SELECT conv_id, t, xor(list_reduce(b, lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) % 4 AS h FROM bits),
made AS (SELECT c.conv_id, [{'role': x.role, 'text': x.text} FOR x IN list_concat(list_slice(coalesce(b.t, []), 1, c.h), list_slice(c.t, c.h + 1, len(c.t)))] AS r
         FROM head c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
steps AS (SELECT conv_id, len(r) AS n, unnest(range(0, len(r) + 1)) AS depth, r FROM made),
prefixes AS (SELECT conv_id, n, depth, list_slice(r, 1, depth) AS p FROM steps),
nodes AS (SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256,
                 CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(p[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS words FROM prefixes GROUP BY depth, p),
named AS (SELECT x.conv_id AS member, x.depth, n.conv_id FROM prefixes x JOIN nodes n ON n.depth = x.depth AND n.p = x.p),
up AS (SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, n.words, n.ends_sha256 FROM nodes n LEFT JOIN named a ON a.member = n.conv_id AND a.depth = n.depth - 1),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN children USING (conv_id, depth)),
sums AS (SELECT a.conv_id, a.depth, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens
         FROM full_nodes f JOIN named a ON a.member = f.conv_id AND a.depth <= f.depth GROUP BY 1, 2)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM full_nodes JOIN sums USING (conv_id, depth)
"""


@query("op13_prefix_trie", SQL)
def op13(spark, sf_dir):
    return prefix_trie(rebuilt(paths(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))
