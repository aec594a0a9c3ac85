"""Small tables with nulls, empty and long texts, ties, repeats and clashing names, against brute force."""
import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from routekit.llm import classes, decontaminate, licences, lines, pieces, quality, secrets, simhash, substrings, warc

SPACES = "[\x20\x09-\x0d]+"
BASE = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix potions under the old stone bridge near town and nobody in the village ever asks them why they do it so late at night"
FIELDS = "doc_id long, text string, token string, at string, n string, word string"


def words(text):
    return [w for w in re.split(SPACES, text or "") if w]


def rows(*texts):
    return [(k, t, "x", "y", "z", "w") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    changed = BASE.replace("lazy", "sleepy")
    return [BASE, None, "", "  \t\n", BASE, changed, "one", BASE + "\n" + changed, " ".join(f"w{k}" for k in range(6000)), "x" * 50_000, "Über ÄÖ a b c d e f g h\n\n" + BASE, "one two three four five\none two three four five\nfive four three two one"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([*rows(*texts), (None, BASE, "x", "y", "z", "w")], FIELDS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FIELDS)


def test_simhash(spark, docs, texts, empty):
    def print_of(text):
        found = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = words(found)
        shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = {k: print_of(t) for k, t in enumerate(texts)}
    got = {r.id: r for r in simhash.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()}
    assert {k: r.fp & (1 << 64) - 1 for k, r in got.items()} == want
    part = {k: {k} for k in want}
    for a in want:
        for b in want:
            if (want[a] ^ want[b]).bit_count() <= 2:
                joined = part[a] | part[b]
                for k in joined:
                    part[k] = joined
    assert {k: r.component for k, r in got.items()} == {k: min(s) for k, s in part.items()}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(docs).count() == len(texts) + 1


def test_simhash_crowded_blocks_link_like_pairs(spark):
    prints = [0] + [1 << k for k in range(40)] + [(1 << a) | (1 << b) | (7 << 50) for a in range(12) for b in range(a)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(prints)], "fp long, node long")

    def parts(crowd):
        return {(r.node, r.component) for r in simhash.components(simhash.close_links(df, 2, crowd), by=[]).collect()}

    assert parts(4) == parts(10_000) != set()


def test_quality_counts(spark, docs, texts):
    long_repeat = "a b c d e f g h " * 30
    more = spark.createDataFrame([(100, long_repeat), (101, "x y z w\nq\nx y z w\n \n \n# * &<b>")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.base_rules(docs.select("doc_id", "text").where("doc_id IS NOT NULL").unionByName(more)).collect()}
    for k, t in [*enumerate(texts), (100, long_repeat), (101, "x y z w\nq\nx y z w\n \n \n# * &<b>")]:
        w, text = words(t), t or ""
        windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(8)}
        held = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(held) - len(set(held)), len(covered))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, k
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_quality_ratio_rejects_unlike_texts(spark, empty):
    good = [(k, f"{BASE} number {k} and some more words of plain prose about rivers") for k in range(12)]
    bad = [(100 + k, " ".join(f"{w}!!" for w in BASE.upper().split()) + f" !! {k}") for k in range(12)]
    docs = spark.createDataFrame([*good, *bad, (None, BASE), (200, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, "q") for k in range(6)] + [(100 + k, 0, "q") for k in range(6)] + [(1, 1, "q"), (None, 1, "q"), (7, None, "q")], "doc_id long, quality int, text string")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).collect()}
    assert all(kept[k] for k in range(12)) and not any(kept[100 + k] for k in range(12)) and kept[200] is False and kept[None]
    assert {r.kept for r in quality.quality_rules(docs.where("doc_id < 100"), labels.limit(0)).collect()} == {True}
    assert quality.quality_rules(empty, labels).count() == 0


def test_lines(spark, docs, texts, empty):
    seen, gone = [], defaultdict(set)
    for k, text in enumerate(texts):
        for at, line in enumerate((text or "").split("\n")):
            s = {w for w in words(line.lower())}
            if s:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    gone[k].add(at)
                seen.append(s)
    out = lines.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = {r.doc_id: r for r in out.where("doc_id IS NOT NULL").collect()}
    for k, text in enumerate(texts):
        want = None if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if at not in gone[k])
        assert (got[k].text, got[k].n_removed) == (want, len(gone[k])), k
    assert lines.line_dedup(empty).count() == 0 and out.where("doc_id IS NULL").count() == 1


def test_lines_large_group_of_near_copies(spark):
    base = [f"word{k}" for k in range(40)]
    made = [(k, " ".join(w if (k * 7 + j) % 41 else f"other{k}" for j, w in enumerate(base))) for k in range(60)] + [(900, " ".join(f"alone{k}" for k in range(30)))]
    got = {r.doc_id: r.n_removed for r in lines.line_dedup(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {k: int(0 < k < 900) for k, _ in made}


def test_decontamination(spark, empty):
    item = "If Alice buys 12 apples for 3 dollars each and sells 5 of them then how much did Alice pay before Bob came to the market with 12 baskets?"
    swapped = item.replace("Alice", "Carla").replace("12", "47").replace("5 of", "9 of").replace("Bob", "Dieter").replace("3 dollars", "8 euros")
    broken = item.replace("buys 12", "buys 47").replace("with 12", "with 48")
    made = [(1, f"Some words before it. {item} And more after it."), (2, f"Other words first here. {swapped} The end."), (3, f"Hello there. {broken} Bye."), (4, item.upper()), (5, BASE), (6, None), (7, ""), (8, " ".join(item.split()[:12])), (None, item)]
    docs = spark.createDataFrame([(*m, "x") for m in made], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, item, "x"), (10, item, "x"), (11, "too short", "x"), (12, None, "x"), (None, item, "x")], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(1, 10), (2, 10), (4, 10)}
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.leaks(empty, items).count() == 0
    kept = decontaminate.decontaminate(docs, items)
    assert {r.doc_id for r in kept.collect()} == {3, 5, 6, 7, 8, None} and kept.columns == docs.columns
    decontaminate_limit, decontaminate.BROADCAST_WINDOWS = decontaminate.BROADCAST_WINDOWS, 0
    try:  # the way for large benchmarks finds the same
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == found
    finally:
        decontaminate.BROADCAST_WINDOWS = decontaminate_limit


def test_class_model(spark, docs, texts, empty):
    import math
    whole = docs.select(F.col("doc_id").alias("id"), "text", "n")
    train = docs.where("doc_id % 2 = 0").select("text")
    vocabulary, model = classes.train(train)
    low = lambda t: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + ["\n"]
    count = Counter(w for k, t in enumerate(texts) if k % 2 == 0 for w in low(t))
    n, v = sum(count.values()), len(count)
    assert (model["tokens"], model["words"]) == (n, v)
    got = {r.id: r for r in classes.score_texts(whole.select("id", "text"), vocabulary, model).collect()}
    assert set(got) == {*range(len(texts)), None}
    for k, t in enumerate(texts):
        w = low(t)
        assert (got[k].n_tokens, got[k].n_known) == (len(w), sum(count[x] > 0 for x in w))
        assert math.isclose(got[k].base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert got[k].score < 0
    nothing, none = classes.train(empty.select("text"))
    assert (none["tokens"], none["words"]) == (0, 0) and classes.score_texts(whole.select("id", "text"), nothing, none).count() == len(texts) + 1


def test_class_model_sums_to_one(spark):
    text = "a b a b c d c d a b e f " * 20
    vocabulary, model = classes.train(spark.createDataFrame([(text,), ("a b only once seen",)], "text string"))
    entries = vocabulary.collect()
    for history in range(classes.CLASSES):
        known = sum((1 - classes.MIX) * (1 - model["new"][history]) * model["transition"][history, r["class"]] * r["n"] / model["in_class"][r["class"]] + classes.MIX * (r["n"] + 1) / (model["tokens"] + model["words"] + 1) for r in entries)
        unknown = (1 - classes.MIX) * model["new"][history] + classes.MIX / (model["tokens"] + model["words"] + 1)
        filled = sum(model["transition"][history, c] for c in {r["class"] for r in entries})
        missing = (1 - classes.MIX) * (1 - model["new"][history]) * (1 - filled)
        assert abs(known + unknown + missing - 1) < 1e-9


def test_exchange_never_loses_likelihood():
    import numpy as np
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 5, (40, 40)).astype(float)
    counts[:20, 20:] += 30
    counts[20:, :20] += 30

    def value(of):
        member = np.eye(4)[of]
        t = member.T @ counts @ member
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    values = [value(classes.exchange(counts, 4, sweeps)) for sweeps in range(5)]
    assert values == sorted(values) and values[-1] > values[0]
    of = classes.exchange(counts, 4)
    assert not set(of[:20]) & set(of[20:])


def test_substrings(spark, docs, texts, empty):
    texts = [*texts, BASE]  # the row without an id counts like all others
    windows = Counter(tuple(w[k:k + 35]) for t in texts for w in [words(t)] for k in range(len(w) - 34))
    for crowd in (64, 1):
        substrings.CROWD = crowd
        got = {r.doc_id: r for r in substrings.substring_dedup(docs).collect()}
        for k, t in [*enumerate(texts[:-1]), (None, BASE)]:
            w = words(t)
            gone = {i + j for i in range(len(w) - 34) if windows[tuple(w[i:i + 35])] > 1 for j in range(35)}
            assert (got[k].n_words, got[k].n_removed, got[k].kept) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)), (crowd, k)
    substrings.CROWD = 64
    assert substrings.substring_dedup(empty).count() == 0


def test_suffix_automaton_matches_brute_force():
    import random
    rng = random.Random(5)
    for _ in range(30):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(0, 25))] for _ in range(4)]
        machine = substrings.Automaton()
        for k, seq in enumerate(seqs):
            for x in seq:
                machine.add(x, 1)
            machine.add(-1 - k, 0)
        machine.finish()
        count = Counter(tuple(s[i:i + 4]) for s in seqs for i in range(len(s) - 3))
        for s in seqs:
            want = {i + j for i in range(len(s) - 3) if count[tuple(s[i:i + 4])] > 1 for j in range(4)}
            assert {k for a, b in machine.repeated_spans(s, 4) for k in range(a, b)} == want


def test_pieces_equal_the_library(spark, docs, texts, empty):
    import random

    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    got = {r.id: r for r in pieces.encode_texts(docs, pieces.model_path()).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        assert got[k].ids == ids and got[k].decoded == library.decode(ids)
    model = pieces.loaded(open(pieces.model_path(), "rb").read())
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(" ▁\n\tab<0x>é中\U0001f600\x00s/") for _ in range(rng.randint(0, 120)))
        ids, begins, ends = model.encode(t)
        proto = library.encode(t, out_type="proto")
        assert ids.tolist() == [p.id for p in proto.pieces] and model.decode(ids) == library.decode(ids.tolist())
        data = t.encode()
        shown = [data[b:e].decode() for b, e in zip(begins.tolist(), ends.tolist())]
        assert "".join(shown) == t and shown == [p.surface for p in proto.pieces]
    assert pieces.encode_texts(empty, pieces.model_path()).count() == 0


def test_character_map_equals_the_library():
    import sentencepiece
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    model = pieces.PieceModel(library.serialized_model_proto())
    for t in ["Ａ b  ﬁ　x ㍿", "  a\xa0 b ", "é é", "", "   ", "ｶﾞ ½ ﷺ", "plain"]:
        assert model.normalise(t)[0] == library.normalize(t)
    shown, align = model.normalise("Ａ ﬁ")
    assert (shown, align) == ("▁A▁fi", [0, 0, 3, 4, 4, 7])


def test_archives(spark, empty):
    import os

    from routekit.operators.core import scratch_path
    made = [(3, "http://a/\r\nb", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (7, "u", "é" * 5000), (8, "u", "same"), (None, "u", "lone"), (9, "u", "x\r\n\r\nWARC/1.0")]
    pages = spark.createDataFrame([(*m, "q") for m in made], "id long, url string, payload string, refers_to string").repartition(2)
    path = scratch_path(spark, "archives")
    warc.write_archives(pages, path)
    got = {r.id and int(r.id): r for r in warc.read_archives(spark, path).collect()}
    for k, _, payload in made:
        data = (payload or "").encode()
        equal = sorted(i for i, _, p in made if i is not None and (p or "") == (payload or ""))
        first = equal[0] if equal else None
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.payload_digest(data))
        assert (r.record_type, r.refers_to) == (("response", None) if k in (first, None) else ("revisit", str(first)))
        assert r.payload == (data if r.record_type == "response" else None)
    again = scratch_path(spark, "archives")
    warc.write_archives(pages, again, min_revisit=10)
    assert {r.record_type for r in warc.read_archives(spark, again).collect()} == {"response"}
    none = scratch_path(spark, "archives")
    warc.write_archives(empty.select(F.col("doc_id").alias("id"), F.col("text").alias("url"), F.col("text").alias("payload")), none)
    assert warc.read_archives(spark, none).count() == 0
    part = next(f for f in os.listdir(path) if f.startswith("part") and os.path.getsize(f"{path}/{f}") > 60)
    whole = open(f"{path}/{part}", "rb").read()
    with pytest.raises((warc.DamagedArchive, warc.zstandard.ZstdError)):
        list(warc.read_records(whole[:-12]))


def test_archive_dictionary_comes_from_the_leading_frame():
    import struct

    import zstandard
    samples = [f"<html><p>{k} {'common text of all pages ' * 9}{k * 7}</p></html>".encode() for k in range(300)]
    shared = zstandard.train_dictionary(2048, samples)
    press = zstandard.ZstdCompressor(dict_data=shared)
    record = warc.record_bytes("response", 4, "http://x/", samples[0], warc.payload_digest(samples[0]), None)
    for words_ in (shared.as_bytes(), zstandard.ZstdCompressor().compress(shared.as_bytes())):
        data = struct.pack("<II", warc.DICTIONARY, len(words_)) + words_ + press.compress(record) + warc.EMPTY_FRAME.encode() + press.compress(record)
        assert [r["payload"] for r in warc.read_records(data)] == [samples[0]] * 2
    wrong = record.replace(b"Content-Length: %d\r\n\r\nHTTP" % (len(samples[0]) + 99), b"Content-Length: 3\r\n\r\nHTTP").replace(b"common", b"c0mmon")
    with pytest.raises(warc.DamagedArchive):
        warc.parse_record(wrong)


def test_licences(spark, empty):
    plain = [(k, f"{BASE} {k}\nA plain line number {k} about rivers and hills") for k in range(30)]
    made = [*plain, (50, "Hello\nReleased under the MIT License.\nBye"), (51, "Licensed under CC BY-NC 4.0."), (52, None), (53, ""), (54, "This work is licensed under the GNU General Public License, version 3."), (55, "The licence of the ship's captain was granted by the old king")]
    got = {(r.doc_id, r.at): r.family for r in licences.scan(spark.createDataFrame([(*m, "x") for m in made], "doc_id long, text string, line string")).collect()}
    assert got == {(50, 1): "mit", (51, 0): "cc-by-nc", (54, 0): "gpl"}
    assert licences.scan(empty).count() == 0


def test_secrets(spark, empty):
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(40)]
    made = [(k, f'{BASE} token = "{h}" and {1000000000000000 + k * 77777} then') for k, h in enumerate(hexes)]
    made += [(100, f'we set password : "{hexes[0][:24]}Zz9" today'), (101, "see 1234567890123456 only"), (102, None), (103, ""), (104, "http://example.com/aaaaaaaaaaaaaaaaaaaa1/b")]
    got = secrets.scan(spark.createDataFrame([(*m, "x") for m in made], "doc_id long, text string, found string")).collect()
    for r in got:
        assert r.secret == (not r.found.isdigit() and r.doc_id != 104), r
    assert {r.doc_id for r in got} == {*range(40), 100, 101, 104}
    assert secrets.scan(empty).count() == 0


def test_licences_learn_from_every_plain_paragraph(spark, monkeypatch):
    seen, given = [], licences.examples

    def spy(*args):
        out = given(*args)
        seen.append(out.where("label = 0").count())
        return out

    monkeypatch.setattr(licences, "examples", spy)
    licences.scan(spark.range(9000).selectExpr("id AS doc_id", "concat('paragraph of plain words ', id) AS text"))
    assert seen == [9000]
