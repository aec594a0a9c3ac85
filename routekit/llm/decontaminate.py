"""Benchmark decontamination: template windows of documents meet those of benchmark items; slot consistency decides.

Only DataFrame functions. A text becomes tokens (letter runs and numbers, no punctuation). In the template, numbers are
<num>, units after a number <unit>, and names (capitalised words that don't begin a sentence) <name>; other words stand in
lower case. Texts in capitals show no names, so windows in which names stand as words are used beside the others. Windows
of WIDTH tokens meet by hash; a window of an item counts if at most half of it is placeholders. Found windows of one
document and item whose positions differ by about the same distance form a passage; where an item repeats a phrase, its
windows also meet each other's places, so each window of a passage is taken at one place and each place for one window,
those with the distance that most windows of the passage have. A passage is a leak when it covers SHARE percent of the
item's windows and its slots are consistent: over all of it each value of the item stands for one value of the document,
and the other way round.

Cases: null and empty texts have no windows; items of fewer than WIDTH tokens, or of placeholders only, can't be found;
repeated rows of a document or an item give one result; an item found in several places reports its fullest passage, the
first of equals; without items nothing is found; rows with a null id are never reported; an empty table gives an empty
result; other columns, whatever their names, are left alone.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routekit.llm.common import documents, query, table
from routekit.operators.core import checkpoint

WIDTH, SHARE, MAX_SLOTS = 5, 80, 2
BAND = 16  # tokens by which a passage may grow or shrink in the document
BROADCAST_WINDOWS, FILTER_BITS = 200_000, 24
# Units of measure and money that may follow a number.
UNITS = ["kg", "g", "mg", "km", "m", "cm", "mm", "mi", "mile", "miles", "ft", "feet", "inch", "inches", "l", "ml", "litre", "litres", "liter", "liters",
         "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
         "percent", "dollar", "dollars", "euro", "euros", "pound", "pounds", "cent", "cents", "degree", "degrees", "mph"]
PASSAGE = ["doc_id", "item_id", "shift", "band"]
NAME = "\x01"  # stands before a name; no token holds it otherwise
NAMES = r"(?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])"
TOKENS = NAME + r"?\p{L}[\p{L}\p{M}\p{N}_]*|[0-9]+(?:[.,:/][0-9]+)*"


def tokens(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), NAME, " ")
    return F.regexp_extract_all(F.regexp_replace(plain, NAMES, NAME + "$1"), F.lit(TOKENS), F.lit(0))


def is_number(token: Column) -> Column:
    return (token >= "0") & (token < ":")


def is_unit(found: Column, token: Column, at: Column) -> Column:
    return (at > 0) & is_number(F.get(found, F.greatest(at - 1, F.lit(0)))) & F.lower(token).isin(UNITS)


def template(found: Column, names: bool) -> Column:
    """The template tokens of a token array, with names as placeholders or as words."""
    def shown(token, at):
        name = F.lit("<name>") if names else F.lower(F.substring(token, 2, 1 << 30))
        return F.when(is_number(token), "<num>").when(token < "\x02", name).when(is_unit(found, token, at), "<unit>").otherwise(F.lower(token))

    return F.transform(found, shown)


def window_rows(texts: DataFrame, *keep: str) -> DataFrame:
    """(keep..., at, hash): the windows of `text`, in both templates where they can differ.

    Outer explodes: an inner one would make the planner test the arrays first, and so build them twice."""
    def rows(source, names):
        held = source.select(*keep, tokens(F.col("text")).alias("_t")).withColumn("_e", F.transform(template(F.col("_t"), names), lambda w: F.xxhash64(w)))
        windows = F.when(F.size("_e") >= WIDTH, F.transform(F.sequence(F.lit(1), F.size("_e") - (WIDTH - 1)), lambda k: F.xxhash64(F.slice("_e", k, WIDTH))))
        return held.select(*keep, windows.alias("_w")).select(*keep, F.posexplode_outer("_w").alias("at", "hash")).where("hash IS NOT NULL")

    return rows(texts, False).unionByName(rows(texts.where(F.col("text").rlike(NAMES)), True))


def item_windows(items: DataFrame) -> DataFrame:
    """(hash, item_id, item_at), without windows that are mostly placeholders."""
    def slots(names):
        return F.transform(template(F.col("_t"), names), lambda w: F.when(w.startswith("<"), 1).otherwise(0))

    full = items.select("item_id", tokens(F.col("text")).alias("_t")).where(F.size("_t") >= WIDTH).select("item_id", F.posexplode(F.sequence(F.lit(1), F.size("_t") - (WIDTH - 1))).alias("at", "_k"), slots(False).alias("_a"), slots(True).alias("_b"))
    count = lambda c: F.aggregate(F.slice(c, F.col("_k"), WIDTH), F.lit(0), lambda x, y: x + y)
    fine = full.where((count("_a") <= MAX_SLOTS) & (count("_b") <= MAX_SLOTS)).select("item_id", "at").distinct()
    rows = window_rows(items, "item_id").join(fine, ["item_id", "at"], "left_semi")
    return rows.select("hash", "item_id", F.col("at").alias("item_at")).distinct()


def seen_filter(hashes: DataFrame) -> Column:
    """A test on column `hash` that no hash of `hashes` fails; its constant has 2^FILTER_BITS bits for any input."""
    bit = F.pmod("hash", F.lit(1 << FILTER_BITS))
    held = hashes.groupBy(F.floor(bit / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(hash, 64) AS INT))")).alias("bits")).collect()
    bits = dict(map(tuple, held))
    constant = F.split(F.lit(",".join(str(bits.get(k, 0)) for k in range(1 << FILTER_BITS - 6))), ",").cast("array<bigint>")
    return F.get(constant, F.floor(bit / 64).cast("int")).bitwiseAND(F.expr("shiftleft(1L, CAST(pmod(hash, 64) AS INT))")) != 0


def aligned(hits: DataFrame) -> DataFrame:
    """`hits` one-to-one per passage: of those that share an item's or the document's position, the one stays whose distance
    most hits of its passage have (the smallest of equals). In rows: an array expression would be built once per element."""
    step = F.pmod(F.col("at") - F.col("item_at") + F.col("shift") * (BAND // 2), F.lit(BAND))
    support = F.count("*").over(Window.partitionBy(*PASSAGE, "_step"))
    first = lambda place: F.row_number().over(Window.partitionBy(*PASSAGE, place).orderBy(F.desc("_support"), "_step"))
    counted = hits.withColumn("_step", step).withColumn("_support", support)
    ranked = counted.withColumns({"_a": first("item_at"), "_b": first("at")})
    return ranked.where("_a = 1 AND _b = 1").select(*hits.columns)


def found_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, hits): passages that cover enough of an item; hits are (item_at, at)."""
    held = checkpoint(item_windows(items))
    sizes = held.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"))
    rows = window_rows(docs.where("doc_id IS NOT NULL"), "doc_id")
    if held.count() <= BROADCAST_WINDOWS:
        hits = rows.join(F.broadcast(held), "hash")
    else:
        hits = rows.where(seen_filter(held)).join(held, "hash")
    # each hit lies in two of the overlapping bands of distances
    hits = checkpoint(hits.select("doc_id", "item_id", "item_at", "at").distinct())
    band = (F.col("at") - F.col("item_at") + F.col("shift") * (BAND // 2))
    hits = hits.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.floor(band / BAND))
    enough = 100 * F.col("n_found") >= SHARE * F.col("n_windows")
    full = hits.groupBy(*PASSAGE).agg(F.countDistinct("item_at").alias("n_found")).join(sizes, "item_id").where(enough).select(*PASSAGE)
    kept = aligned(hits.join(checkpoint(full), PASSAGE, "left_semi"))
    passages = kept.groupBy(*PASSAGE).agg(F.count("*").alias("n_found"), F.collect_list(F.struct("item_at", "at")).alias("hits"))
    return passages.join(sizes, "item_id").where(enough)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found) for every item that a document of (doc_id, text) holds."""
    docs = docs.select("doc_id", "text")
    items = items.where("item_id IS NOT NULL").select("item_id", "text")
    passages = checkpoint(found_passages(docs, items))
    # passages grow with the corpus, so they meet the texts by a shuffle at every size
    wanted = docs.join(passages.hint("shuffle_hash"), "doc_id").select(*passages.columns, tokens(F.col("text")).alias("doc_tokens")).join(items.select("item_id", tokens(F.col("text")).alias("item_tokens")), "item_id")
    word = lambda c, at: F.lower(F.regexp_replace(F.get(F.col(c), at), NAME, ""))
    item_at = lambda hit, k: hit["item_at"] + k

    def slot(hit, k):
        mine = F.get(F.col("item_tokens"), item_at(hit, k))
        kind = is_number(mine) | (mine < "\x02") | is_unit(F.col("item_tokens"), mine, item_at(hit, k))
        return F.when(kind, F.struct(word("item_tokens", item_at(hit, k)).alias("a"), word("doc_tokens", hit["at"] + k).alias("b")))

    pairs = F.array_distinct(F.array_compact(F.flatten(F.transform("hits", lambda hit: F.array(*(slot(hit, k) for k in range(WIDTH)))))))
    judged = wanted.withColumn("slots", pairs)
    one = lambda side: F.size(F.array_distinct(F.col(f"slots.{side}"))) == F.size("slots")
    fine = judged.where(one("a") & one("b"))
    return fine.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_found").alias("n_found"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item."""
    return docs.join(leaks(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


@query("op2_decontaminate")
def op2(spark, sf_dir):
    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
