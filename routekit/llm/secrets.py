"""Secret scans: candidate strings of all texts, judged by a random forest trained from labelled findings.

Only DataFrame functions and Spark's own DataFrame-based forest. A candidate is a run of MIN_LENGTH or more letters,
digits and +/_=.- with a digit in it, inside a word; a word can hold several, each judged with the run before it and what
stands between and behind. Features: length, character transitions (rates of lower, upper, digit
and other pairs), share of different characters, share of letters in dictionary words (the corpus' own most frequent
words), signs of a path or address around it, quotes and assignment, and the hashed words beside it.

Labelled findings (doc_id, at, secret) can be given. Without them they come from the texts by a labelling rule on at most
TRAINING findings, half of them for each class, those with the smallest hash: a quoted value after a credential name and an assignment is a secret; a
number, a path, an address or a run of dictionary words is not; other findings are left unlabelled and judged by the
forest only.

Cases: null and empty texts have no candidates; very long words are candidates like any other; repeated rows give repeated
findings; rows with a null id are scanned too; if one class only is labelled, every finding is given that class, and
without labels none is called a secret; an empty table gives an empty result; other columns are left alone.
"""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routekit.llm.common import documents, most_frequent, query, smallest_hashes, words
from routekit.operators.core import checkpoint, union_all

MIN_LENGTH, TRAINING, DICTIONARY, NEIGHBOURS = 16, 20_000, 2000, 64
TREES, DEPTH, SEED, LIMIT = 20, 6, 42, 0.5
CANDIDATE = r"[A-Za-z0-9+/_=.-]{16,}"
# Names that credentials are assigned to.
NAMES = ["token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "api-key", "access_key", "secret_key", "auth", "bearer", "credential", "private_key", "client_secret"]
NUMERIC = ["length", "digits", "uppers", "kinds", "coverage", "path", "quoted", "assigned", "ll", "ld", "dl", "dd", "lu", "oo"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, at, run, found, word, before2, before, after): `at` is the position of the word that holds the candidate,
    `run` the number of the run in it, `word` the part of the word around the run."""
    listed = docs.select("doc_id", words(F.col("text")).alias("_w"))
    w = F.col("_w")
    rows = F.filter(F.transform(w, lambda x, at: F.when(F.octet_length(x) >= MIN_LENGTH, F.struct(at.cast("long").alias("at"), x.alias("word")))), lambda s: s.isNotNull())
    context = F.transform(rows, lambda s: F.struct(s["at"].alias("at"), s["word"].alias("word"), *(F.get(w, (s["at"] + k).cast("int")).alias(name) for k, name in ((-2, "before2"), (-1, "before"), (1, "after")))))
    out = listed.select("doc_id", context.alias("_c")).select("doc_id", F.explode_outer("_c").alias("c")).where("c IS NOT NULL").select("doc_id", "c.*")
    out = out.withColumns({"_runs": F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)), "_gaps": F.split("word", CANDIDATE)})
    around = lambda run, k: F.concat(F.coalesce(F.get("_runs", k - 1), F.lit("")), F.get("_gaps", k), run, F.get("_gaps", k + 1))
    listed = F.transform("_runs", lambda run, k: F.struct(k.cast("long").alias("run"), run.alias("found"), around(run, k).alias("word")))
    out = out.withColumn("_r", listed).select("doc_id", "at", "before2", "before", "after", F.explode_outer("_r").alias("r"))
    return out.select("doc_id", "at", "r.*", "before2", "before", "after").where(F.col("found").rlike("[0-9]"))


def frequent_words(docs: DataFrame) -> list[str]:
    """The DICTIONARY most frequent words of three or more letters in all texts, ties in alphabetical order."""
    found = docs.select(F.explode_outer(words(F.lower("text"))).alias("w")).where(F.col("w").rlike("^[a-z]{3,}$"))
    return most_frequent(found, DICTIONARY)


def bare(word: str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.col(word), F.lit(""))), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    c, n = F.col("found"), F.length("found").cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    known = F.split(F.lit(" ".join(dictionary)), " ")
    runs = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)), lambda x: F.array_contains(known, x))
    joins = F.coalesce(F.col("before").isin("=", ":", ":=", "=>") | F.col("before").rlike("[=:]$") | F.col("word").rlike(r"^\W*[A-Za-z_-]+\s*[=:]"), F.lit(False))
    values = {
        "length": n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "kinds": F.size(F.array_distinct(F.split(c, ""))) / n,
        "coverage": F.aggregate(runs, F.lit(0), lambda a, x: a + F.length(x)) / n,
        "path": F.when(F.col("word").rlike(r"://|@|^/|/.*/|\.(com|org|net|html?|php|js)"), 1.0).otherwise(0.0),
        "quoted": F.when(F.col("word").rlike(r"""["'`]"""), 1.0).otherwise(0.0), "assigned": F.when(joins, 1.0).otherwise(0.0),
        "ll": share("(?<=[a-z])(?=[a-z])"), "ld": share("(?<=[A-Za-z])(?=[0-9])"), "dl": share("(?<=[0-9])(?=[A-Za-z])"), "dd": share("(?<=[0-9])(?=[0-9])"),
        "lu": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"), "oo": share("[+/_=.-]"),
    }
    return found.withColumns(values).withColumn("beside", F.array_compact(F.array(F.concat(F.lit("<"), bare("before2")), F.concat(F.lit("<"), bare("before")), F.concat(F.lit(">"), bare("after")))))


def labelled_by_rule(found: DataFrame) -> DataFrame:
    """Adds `secret` where the labelling rule is sure."""
    named = bare("before").isin(NAMES) | (F.col("before").isin("=", ":", ":=", "=>") & bare("before2").isin(NAMES)) | F.lower("word").rlike("(token|secret|passw(or)?d|api_?key)[\"']?[=:]")
    sure = named & (F.col("assigned") == 1) & (F.col("path") == 0)
    return found.withColumn("secret", F.when(sure & (F.col("quoted") == 1), True).when(F.col("found").rlike("^[0-9.-]+$") | (F.col("path") == 1) | (F.col("coverage") > 0.6), False))


def scan(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, at, run, found, score, secret) for every candidate of `docs` (doc_id, text)."""
    found = checkpoint(features(candidates(docs), frequent_words(docs)))
    marked = found.join(labels.select("doc_id", "at", "secret"), ["doc_id", "at"]) if labels is not None else labelled_by_rule(found)
    marked = marked.where("secret IS NOT NULL").withColumn("label", F.col("secret").cast("double"))
    marked = marked.withColumn("h", F.xxhash64("doc_id", "at", "found"))
    training = checkpoint(union_all([smallest_hashes(marked.where(F.col("label") == label), TRAINING // 2, "doc_id", "at", "run") for label in (0.0, 1.0)]))
    kinds = [r["label"] for r in training.select("label").distinct().collect()]
    if len(kinds) < 2:
        score = F.lit(float(kinds[0]) if kinds else 0.0)
        return found.select("doc_id", "at", "run", "found", score.alias("score"), (score >= LIMIT).alias("secret"))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    model = Pipeline(stages=[HashingTF(inputCol="beside", outputCol="hashed", numFeatures=NEIGHBOURS, binary=True), VectorAssembler(inputCols=[*NUMERIC, "hashed"], outputCol="features"), forest]).fit(training)
    score = F.round(vector_to_array("probability")[1], 6)
    return model.transform(found).select("doc_id", "at", "run", "found", score.alias("score"), (score >= LIMIT).alias("secret"))


@query("op8_secrets")
def op8(spark, sf_dir):
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", F.col("at").alias("word_at"), F.col("run").alias("run_at"), F.length("found").cast("long").alias("n_chars"), F.sha2("found", 256).alias("found_sha256"), "score", "secret")
