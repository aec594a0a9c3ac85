"""The stages on a small folder of tables, each against a brute-force version of its rule on its own input."""
import random
import re

import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from routekit.llm import pieces
from routekit.operators.core import checkpoint
from tests.llm.test_copies import brute

SPACES = "[\x20\x09-\x0d]+"
ITEM = "Which of the nine old rivers in the northern province carries more water in spring than all of the others do together?"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    texts = [prose(60) + "\n" + prose(40) for _ in range(30)]
    texts += [texts[0], texts[1].replace(texts[1].split()[3], "changed", 1), prose(30) + " " + ITEM + " " + prose(20), "too short", None, ""]
    texts += [" ".join(f"{w.upper()}!!" for w in prose(50).split()) for _ in range(12)]
    texts += [f"{prose(50)}\nall rights reserved\n{prose(30)}\nmenu" for _ in range(3)]  # short lines that repeat
    for changes in (0, 2, 9):  # the words of an earlier text, broken into other lines: a copy, a near copy and an unlike text
        w = texts[5 + changes].split()
        for at in rng.sample(range(len(w)), changes):
            w[at] = f"other{at}"
        texts.append("\n".join(" ".join(part) for part in (w[:25], w[25:75], w[75:])))
    docs = [(k, t, "en", "src", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 30), 0) for k in [*range(20), *range(36, 44)]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def words(text):
    return [w for w in re.split(SPACES, text or "") if w]


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, last = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, folder))
        assert docs.columns == columns
        now = {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            assert set(now) == {k for k, r in last.items() if len(words(r.text)) >= 20 and "!!" not in r.text}
        elif name == "line_dedup":
            assert set(now) == set(last)
            seen = []
            for k in sorted(last):
                kept = []
                for line in last[k].text.split("\n"):
                    s = set(words(line.lower()))
                    near = bool(s) and any(5 * len(s & o) >= 4 * len(s | o) for o in seen)
                    seen += [s] if s else []
                    kept += [] if near else [line]
                assert now[k].text == "\n".join(kept) and now[k].n_chars == len(now[k].text)
            assert sum("all rights reserved" in r.text for r in now.values()) == sum("\nmenu" in r.text for r in now.values()) == 1
        elif name == "near_dedup":
            assert set(now) == set(brute([(k, r.text) for k, r in last.items()]).values())
            gone = set(last) - set(now)
            assert {51, 52} <= gone and 53 not in gone
        else:
            assert set(last) - set(now) == {k for k, r in last.items() if ITEM in r.text}
        last = now
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {k: r.ids for k, r in got.items()} == {k: library.encode(r.text, add_eos=True) for k, r in last.items()}


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in entry.queries()
