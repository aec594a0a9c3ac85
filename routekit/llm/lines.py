"""Line dedup: an exact set-similarity self-join of all lines, with prefix, positional and length filters.

Only DataFrame functions. A line is what stands between line ends (\\n); its tokens are its distinct words in lower case.
A line with at least one word is removed when a line before it (smaller document id, then smaller position) has Jaccard
similarity 0.8 or more with it; this is judged on the input, so a removed line still removes later ones. Sets of fewer
than JOINED words are similar to equal sets only (three words of four are 0.75), so they take no part in the joins.

Cases: null texts stay null and empty texts stay empty; a document that loses every line keeps its row with an empty text;
rows with a null id stay whole; of rows that repeat an id, the least token list of each position is compared, and all of
them lose the same lines; an empty table gives an empty result; other columns of the input, whatever their names, are kept as they are.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routekit.llm.common import documents, literal_array, query
from routekit.operators.core import checkpoint, release, union_all

JOINED, PERCENT = 4, 80
COUNTERS = 1 << 18
KEYS = 4
SLICES = 4
LINE = ("doc_id", "at")


def spaced(text: Column) -> Column:
    """The text in lower case, all of whose separators but line ends are spaces; this and a split at one character are much cheaper than a pattern."""
    for separator in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(separator), F.lit(" "))
    return F.lower(text)


def line_words(line: Column) -> Column:
    """The words of a `spaced` line."""
    return F.array_remove(F.split(line, " "), "")


def rarity_classes(docs: DataFrame) -> Column | None:
    """log2 of how often the words of each of COUNTERS hash counters occur in all lines, as a constant array.

    Any fixed order gives exact results; counters that several words share only make it less sharp. COUNTERS rows reach
    the driver whatever the input."""
    return counter_classes(docs.select(F.explode_outer(line_words(F.replace(spaced(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(" ")))).alias("w")))


def counter_classes(found: DataFrame) -> Column | None:
    """The same for the values of column `w`; None if there are none."""
    rows = found.where("w IS NOT NULL").groupBy(F.pmod(F.xxhash64("w"), F.lit(COUNTERS)).cast("int").alias("at")).agg(F.floor(F.log2(F.count("*").cast("double"))).cast("int").alias("class")).toArrow()
    if not rows.num_rows:
        return None
    classes = np.zeros(COUNTERS, np.int64)
    classes[rows["at"].to_numpy()] = rows["class"].to_numpy()
    return literal_array(classes.tolist(), "int")


def ordered_tokens(line: Column, classes: Column) -> Column:
    """Distinct token keys, rarest first: rarity class, then long words before short ones (words that share a counter are
    told apart by their length, since long words are rarer), then 51 bits of the word's hash."""
    def key(w):
        h = F.xxhash64(w)
        rare = F.shiftleft(F.get(classes, F.pmod(h, F.lit(COUNTERS)).cast("int")).cast("long"), 57)
        short = F.shiftleft((F.lit(63) - F.least(F.octet_length(w), F.lit(63))).cast("long"), 51)
        return rare.bitwiseOR(short).bitwiseOR(F.shiftrightunsigned(h, 13))

    return F.sort_array(F.array_distinct(F.transform(line_words(line), key)))


def least_overlap(n: Column) -> Column:
    """The least number of common tokens with any set as large or larger: ceil(0.8 n), in integers."""
    return F.floor((n * PERCENT + 99) / 100).cast("int")


def numbered_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode_outer(F.split(spaced(F.col("text")), "\n")).alias("at", "line")).where("line IS NOT NULL AND trim(line) <> ''")


def fits(n_u, pos_u, n_v, pos_v) -> Column:
    """Length filter, and positional filter: what can still be common must reach the overlap that 0.8 asks for."""
    needed = F.floor((PERCENT * (n_u + n_v) + 99 + PERCENT) / (100 + PERCENT))
    possible = F.least(pos_u, pos_v) + 1 + F.least(n_u - pos_u, n_v - pos_v) - 1
    return (F.least(n_u, n_v) >= least_overlap(F.greatest(n_u, n_v))) & (possible >= needed)


PAIR = ("u_doc_id", "u_at", "v_doc_id", "v_at")
MARKS = ("n", "even", "odd")


def parity(tokens: Column, odd: bool) -> Column:
    """64 bits, each the parity of how many tokens fall on it; `odd`: of those tokens alone that have an odd last bit."""
    one = (lambda t: t.bitwiseAND(F.lit(1).cast("long"))) if odd else (lambda t: F.lit(1).cast("long"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(F.call_function("shiftleft", one(t), F.shiftright(t, 1).bitwiseAND(F.lit(63).cast("long")).cast("int"))))


def run_keys(tokens: Column, n: Column) -> Column:
    """At most KEYS hashes of two tokens that are neighbours in the rarity order, the smallest of the first 0.4 n + 1.

    Similar sets have such a pair in common: each of the at most (n_u + n_v) / 9 tokens that only one of them has parts
    one pair of common tokens at most, so one of the first pairs is left whole in both."""
    upto = F.floor(n * 2 / 5).cast("int") + 2
    pairs = F.zip_with(F.slice(tokens, 1, upto - 1), F.slice(tokens, 2, upto - 1), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.slice(F.sort_array(F.array_compact(pairs)), 1, KEYS)


def apart() -> Column:
    """At most the number of tokens that only one of two sets has: the bits in which their parities differ."""
    return sum((F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}"))) for c in ("even", "odd")), F.lit(0))


def may_be_similar() -> Column:
    """Length filter, and the parities' bound: J >= 0.8 leaves at most (n_u + n_v) / 9 tokens outside."""
    n_u, n_v = F.col("u_n"), F.col("v_n")
    return (apart() * (100 + PERCENT) <= (100 - PERCENT) * (n_u + n_v)) & (100 * F.least(n_u, n_v) >= PERCENT * F.greatest(n_u, n_v))


def earlier() -> Column:
    return (F.col("u_doc_id") < F.col("v_doc_id")) | ((F.col("u_doc_id") == F.col("v_doc_id")) & (F.col("u_at") < F.col("v_at")))


def lines_of(pairs: DataFrame, docs: DataFrame, classes: Column, repeated: bool) -> DataFrame:
    """(doc_id, at, tokens) of the lines in `pairs`, once each; they are split anew from the texts, since the tokens of all
    lines would take more disk than the texts."""
    ends = pairs.select(F.explode(F.array(*(F.struct(*(F.col(f"{s}_{c}").alias(c) for c in LINE)) for s in "uv"))).alias("e")).select("e.*")
    listed = ends.groupBy("doc_id").agg(F.collect_set("at").alias("_ats"))
    lines = docs.join(listed, "doc_id").select("doc_id", F.explode("_ats").alias("at"), F.split(spaced(F.col("text")), "\n").alias("_lines"))
    tokens = lines.select(*LINE, ordered_tokens(F.coalesce(F.get("_lines", F.col("at")), F.lit("")), classes).alias("tokens"))
    return checkpoint(one_per_position(tokens) if repeated else tokens)


def one_per_position(tokens: DataFrame) -> DataFrame:
    """Of rows that share an id and a position, the least token list that isn't empty."""
    return tokens.groupBy(*LINE).agg(F.min(F.when(F.size("tokens") > 0, F.col("tokens"))).alias("tokens")).where("tokens IS NOT NULL")


def similar(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, at) of the later sets of `pairs` that are similar to the earlier one."""
    side = lambda s: held.select(*(F.col(c).alias(f"{s}_{c}") for c in LINE), F.col("tokens").alias(f"{s}_tokens"))
    both = pairs.select(*PAIR).join(side("v"), ["v_doc_id", "v_at"]).join(side("u"), ["u_doc_id", "u_at"])
    common = F.size(F.array_intersect("u_tokens", "v_tokens"))
    near = both.where(100 * common >= PERCENT * (F.size("u_tokens") + F.size("v_tokens") - common))
    return checkpoint(near.select(F.col("v_doc_id").alias("doc_id"), F.col("v_at").alias("at")).distinct())


def nearest_of_each(pairs: DataFrame) -> DataFrame:
    """One pair for each later set, that with the fewest differing bits."""
    return pairs.groupBy("v_doc_id", "v_at").agg(F.min(F.struct("apart", "u_doc_id", "u_at")).alias("_u")).select("_u.u_doc_id", "_u.u_at", "v_doc_id", "v_at", "_u.apart")


def star_pairs(sets: DataFrame) -> DataFrame:
    """Every set with the earliest holder of each of its run keys, where the filters let them be similar; the nearest of these."""
    held = sets.select(*(F.col(c).alias(f"v_{c}") for c in (*LINE, *MARKS)), F.explode("keys").alias("key"))
    firsts = held.groupBy("key").agg(F.min(F.struct(*(f"v_{c}" for c in (*LINE, *MARKS)))).alias("_u"), F.count("*").alias("holders")).where("holders > 1")
    met = held.join(firsts.select("key", *(F.col(f"_u.v_{c}").alias(f"u_{c}") for c in (*LINE, *MARKS))), "key").where(earlier() & may_be_similar())
    return nearest_of_each(met.select(*PAIR, apart().alias("apart")))


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """All pairs of an earlier set and a later one that is not `settled`, whose prefixes share a token and pass the filters.

    Settled sets stand on the earlier side only, so a large settled group is not paired. Slices deal tokens, so the
    shuffle of one slice is needed at a time; a pair that several slices find is one pair in the end."""
    entries = sets.select(*LINE, *MARKS, "settled", F.posexplode("prefix").alias("pos", "token"))
    side = lambda rows, s: rows.select("token", *(F.col(c).alias(f"{s}_{c}") for c in (*LINE, *MARKS, "pos")))
    fit = fits(*(F.col(f"{s}_{c}") for s in "uv" for c in ("n", "pos")))
    found = []
    for part in range(SLICES):
        mine = entries.where(F.pmod("token", F.lit(SLICES)) == part)
        met = side(mine, "u").join(side(mine.where("NOT settled"), "v"), "token").where(earlier() & may_be_similar() & fit)
        found.append(checkpoint(met.select(*PAIR, apart().alias("apart")).distinct()))
    return union_all(found).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, at): the lines of `docs` (doc_id, text) that an earlier line removes.

    Equal token sets are one set, standing at its first line. Every set first meets the earliest holders of its run keys:
    that settles most members of a large group of near copies without pairing the group. Sets that are not settled meet
    all earlier ones over prefix tokens, and are verified against the nearest one first and against the others, if that
    one doesn't settle them, afterwards."""
    classes = rarity_classes(docs)
    if classes is None:
        return docs.select("doc_id", F.lit(0).alias("at")).where("false")
    docs = docs.where("doc_id IS NOT NULL")
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    tokens = numbered_lines(docs).select(*LINE, ordered_tokens(F.col("line"), classes).alias("tokens"))
    n = F.size("tokens")
    large = n >= JOINED
    written = checkpoint((one_per_position(tokens) if repeated else tokens).select(
        *LINE, n.alias("n"), F.xxhash64("tokens").alias("set"), F.when(large, F.slice("tokens", 1, n - least_overlap(n) + 1)).alias("prefix"),
        F.when(large, run_keys(F.col("tokens"), n)).alias("keys"), F.when(large, parity(F.col("tokens"), False)).alias("all"), F.when(large, parity(F.col("tokens"), True)).alias("odd")))
    kept = ("all", "odd", "prefix", "keys")
    firsts = written.groupBy("set", "n").agg(F.min(F.struct(*LINE)).alias("first"), F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in kept))
    sets = checkpoint(firsts.select("first.*", "set", "n", "copies", "prefix", "keys", F.col("all").bitwiseXOR(F.col("odd")).alias("even"), "odd"))
    several = sets.where("copies > 1").select("set", "n", F.struct(*LINE).alias("first"))
    copies = checkpoint(written.select(*LINE, "n", "set").join(several, ["set", "n"]).where(F.struct(*LINE) > F.col("first")).select(*LINE))
    release(written)
    joined = sets.where(F.col("n") >= JOINED)
    stars = checkpoint(star_pairs(joined))
    held = lines_of(stars, docs, classes, repeated)
    settled = similar(stars, held)
    release(stars, held)
    flagged = checkpoint(joined.drop("set", "copies", "keys").join(settled.withColumn("settled", F.lit(True)), list(LINE), "left").withColumn("settled", F.coalesce("settled", F.lit(False))))
    release(sets)
    pairs = checkpoint(prefix_pairs(flagged))
    release(flagged)
    held = lines_of(pairs, docs, classes, repeated)
    nearest = checkpoint(nearest_of_each(pairs))
    next_settled = similar(nearest, held)
    left = pairs.join(next_settled.select(F.col("doc_id").alias("v_doc_id"), F.col("at").alias("v_at")), ["v_doc_id", "v_at"], "left_anti").join(nearest.select(*PAIR), list(PAIR), "left_anti")
    last = similar(left, held)
    release(pairs, nearest, held)
    return checkpoint(copies.unionByName(settled).unionByName(next_settled).unionByName(last).distinct())


def line_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `text` rebuilt from the lines that stay, and n_lines, n_removed (long)."""
    gone = removed_lines(docs.select("doc_id", F.col(text).alias("text"))).groupBy("doc_id").agg(F.collect_set("at").alias("_gone"))
    lines = F.split(F.col(text), "\n")
    joined = docs.join(gone, "doc_id", "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda at: F.get(lines, at)), "\n"))
    return joined.select(*(kept.alias(c) if c == text else F.col(c) for c in docs.columns),
                         F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


@query("op7_line_dedup")
def op7(spark, sf_dir):
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
