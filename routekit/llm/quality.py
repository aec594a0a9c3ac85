"""Quality rules: word-shape and repetition counts, then a hashed n-gram log-likelihood ratio against a trusted target.

Only DataFrame functions. Cases: null and empty texts have no words and fail the base rules; documents without a label
count in the raw corpus only; repeated label rows count once (quality 1 wins); without any trusted document, or with one
label class only, the ratio rejects nothing; ties at the threshold are kept; every row is judged by its own text, so rows
with a null id have a ratio and a verdict like others (but no label), and rows that repeat an id with other texts have
their own; a label counts for each row of its id; other columns of the input are left alone.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routekit.llm.common import literal_array, query, table, words
from routekit.operators.core import checkpoint

BUCKETS = 1 << 16
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
# Fixed value: the symbols that the contract of the base rules counts.
SYMBOLS = "#*$%&|<>"
PARTS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def window_hashes(hashes: Column, width: int) -> Column:
    """One hash for each run of `width` neighbours; empty for shorter arrays."""
    return F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), lambda at: F.xxhash64(F.slice(hashes, at, width)))
                  ).otherwise(F.array().cast("array<bigint>"))


def covered_words(windows: Column, width: int) -> Column:
    """How many words lie in a window that occurs more than once; only texts with such a window pay for the sort."""
    ordered = F.sort_array(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))

    def starts(rows: Column) -> Column:
        n = F.size(rows)
        same = lambda at, other: F.coalesce(F.get(rows, at)["h"] == F.get(rows, other)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda at: same(at, at + 1) | ((at > 0) & same(at, F.greatest(at - 1, F.lit(0))))),
                                        lambda at: F.get(rows, at)["at"]))

    def total(found: Column) -> Column:
        steps = F.transform(found, lambda start, at: F.least(F.lit(width), F.coalesce(F.get(found, at + 1) - start, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # a let: the value is computed once
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(once(once(ordered, starts), total))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", words(F.col(text))).withColumn("_lines", F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_windows", window_hashes(F.col("_hashes"), WINDOW))
    out = out.select(*docs.columns, F.size("_words").cast("long").alias("n_words"),
                     F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                     F.length(F.regexp_replace(whole, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                     (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                     covered_words(F.col("_windows"), WINDOW).cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def grams(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """A row for each hashed unigram and bigram of words and punctuation runs, in lower case: keep..., bucket.

    Outer explodes: an inner one would make the planner test the arrays first, and so build them twice."""
    parts = docs.select(*keep, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(PARTS), F.lit(0)).alias("_p"))
    pairs = parts.select(*keep, F.inline_outer(F.arrays_zip("_p", F.slice("_p", 2, F.greatest(F.size("_p"), F.lit(1))))).alias("a", "b"))
    one, two = F.xxhash64("a"), F.xxhash64("a", "b")
    both = pairs.select(*keep, F.explode_outer(F.array(F.when(F.col("a").isNotNull(), one), F.when(F.col("b").isNotNull(), two))).alias("_h")).where("_h IS NOT NULL")
    return both.select(*keep, F.pmod("_h", F.lit(BUCKETS)).cast("int").alias("bucket"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) once per document."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> Column | None:
    """log P(bucket | trusted) - log P(bucket | raw) as a constant array of BUCKETS numbers; add-one smoothed counts over
    every document. Only the counts per bucket reach the driver, as many for any input.

    Labels grow with the corpus, so they are joined by a shuffle at every size."""
    marked = docs.select("doc_id", "text").join(trusted_ids(labels).hint("shuffle_hash"), "doc_id", "left").select("text", (F.coalesce("quality", F.lit(0)) == 1).cast("long").alias("_good"))
    rows = grams(marked, "_good").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_good").alias("good")).collect()
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for row in rows:
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["good"]
    if not sum(good):
        return None
    shift = math.log((sum(raw) + BUCKETS) / (sum(good) + BUCKETS))
    return literal_array([round(math.log((g + 1) / (r + 1)) + shift, 6) for r, g in zip(raw, good)], "double")


def text_hash(text: str = "text") -> Column:
    """Tells the texts of one id apart, and those of rows without an id."""
    return F.xxhash64(text).alias("text_hash")


def ratio_scores(docs: DataFrame, ratios: Column | None) -> DataFrame:
    """(doc_id, text_hash, ratio): the mean log ratio over a text's n-grams, rounded to 1e-6; sums meet per text before the shuffle."""
    marked = docs.select("doc_id", "text", text_hash())
    if ratios is None:
        return marked.select("doc_id", "text_hash", F.lit(0.0).alias("ratio")).distinct()
    scored = grams(marked, "doc_id", "text_hash").select("doc_id", "text_hash", F.get(ratios, F.col("bucket")).alias("_r"))
    return scored.groupBy("doc_id", "text_hash").agg(F.round(F.avg("_r"), 6).alias("ratio"))


def threshold(scores: DataFrame, labels: DataFrame) -> float:
    """The ratio that splits labelled documents best (share of good kept + share of bad rejected), the lowest of
    equals, in the middle of the gap around it.

    Labelled scores meet in bins of 0.01, so a bounded number of rows is compared whatever the input."""
    binned = scores.join(trusted_ids(labels), "doc_id").groupBy(F.floor(F.col("ratio") * 100).cast("int").alias("bin")).agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad"))
    rows = sorted((r["bin"], r["good"], r["bad"]) for r in binned.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return -math.inf
    best, at, kept, out, last = 1.0, -math.inf, good, 0, None
    for bin_, g, b in rows:
        if last is not None and kept / good + out / bad > best:
            best, at = kept / good + out / bad, (bin_ + last + 1) / 200
        kept, out, last = kept - g, out + b, bin_
    return at


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, base counts, base_failed, ratio, kept) for every document.

    `kept` needs the base rules passed and a ratio at or over the threshold learned from all labelled documents."""
    docs = docs.select("doc_id", "text")
    ratios = log_ratios(docs, labels)
    scores = checkpoint(ratio_scores(docs, ratios))
    limit = threshold(scores, labels)
    base = base_rules(docs.withColumn("text_hash", text_hash())).drop("text")
    known = scores.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "ratio")
    base = base.join(known, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id", "_hash", "text_hash")
    passed = F.coalesce(F.col("ratio") >= limit, F.lit(True)) if limit > -math.inf else F.lit(True)
    return base.withColumn("kept", ~F.col("base_failed") & passed)


@query("op4_quality_rules")
def op4(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
