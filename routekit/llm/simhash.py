"""SimHash near-duplicates: word-shingle fingerprints, pigeonhole blocks, verified Hamming distance, components.

Cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle are one
shingle; equal texts share a fingerprint and cost one row in the join; an empty table gives an empty result; other
columns of the input, whatever their names, are left alone.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from routekit.llm.common import documents, query
from routekit.operators.core import checkpoint
from routekit.operators.graph import components

STEP = 1 << 15


def text_fingerprint(data: bytes | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; the hashes are counted in bounded steps."""
    found = data.lower().split() if data else []
    if not found:
        return 0
    digest, n, counts = xxhash.xxh64_digest, max(1, len(found) - width + 1), np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = found[at:at + STEP + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if n > 1 or len(found) == width else [b" ".join(found)]
        hashes = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8)
        counts += np.unpackbits(hashes).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, width: int = 3) -> Column:
    @pandas_udf("long")
    def of(data: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(x, width) for x in data], dtype="int64")

    return of(F.coalesce(text, F.lit("")).cast("binary"))


def block_keys(fp: Column, distance: int) -> Column:
    """Fingerprints within `distance` agree on two of distance + 2 blocks: one key for each choice of two blocks."""
    n = distance + 2
    edges = [64 * k // n for k in range(n + 1)]
    block = [F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(n)]
    return F.array(*(F.struct(F.lit(16 * i + j).cast("short").alias("pair"), block[i].alias("a"), block[j].alias("b")) for i, j in combinations(range(n), 2)))


def close_links(prints: DataFrame, distance: int = 2, crowd: int = 64) -> DataFrame:
    """(u, v) links over distinct fingerprints `prints` (fp, node) whose closure is that of all pairs within `distance`.

    A block with up to `crowd` members pairs them and verifies each pair. The members of fuller blocks (many near copies
    of one text) are linked exactly without pairs: two fingerprints differ in at most two bits iff one fingerprint is
    within one bit of both, so each sends its node to itself and its 64 one-bit neighbours, and all that meet are linked
    to the smallest. That way is for distance 2; for other distances every block pairs its members.
    """
    keyed = prints.select("fp", "node", F.explode(block_keys(F.col("fp"), distance)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = F.col("n") > crowd if distance == 2 else F.lit(False)
    shared = checkpoint(keyed.join(sizes, "key").withColumn("crowded", crowded))
    few = shared.where("NOT crowded")
    a, b = (few.select("key", F.col("fp").alias(f"fp_{s}"), F.col("node").alias(s)) for s in "uv")
    pairs = a.join(b, "key").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) <= distance)).select("u", "v").distinct()
    many = shared.where("crowded").select("fp", "node").distinct()
    one_bit = np.concatenate([[0], (np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64)]).tolist()
    near = many.select("node", F.explode(F.transform(F.array(*map(F.lit, one_bit)), lambda bit: F.col("fp").bitwiseXOR(bit))).alias("near"))
    stars = near.join(near.groupBy("near").agg(F.min("node").alias("u")), "near").where("u < node").select("u", F.col("node").alias("v")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over fingerprints within `distance` bits."""
    prints = checkpoint(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fp")))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("node")))
    joined = components(checkpoint(close_links(nodes, distance)), by=[])
    named = nodes.join(joined.withColumnRenamed("component", "_component"), "node", "left").select("fp", F.coalesce("_component", "node").alias("component"))
    return prints.join(named, "fp").select("id", "fp", "component")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


@query("op1_simhash")
def op1(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
