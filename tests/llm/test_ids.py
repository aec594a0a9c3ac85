"""Ids that repeat, are null or are no numbers, and columns with the names of inner ones, against brute force."""
import math
import re
from collections import Counter

import pytest
import regex
import xxhash

from routekit.llm import quality, substrings, warc
from routekit.operators.core import scratch_path

SPACES = "[\x20\x09-\x0d]+"
LONG = " ".join(f"stone{k} bridge{k * k % 17}" for k in range(40))


def words(text):
    return [w for w in re.split(SPACES, text or "") if w]


@pytest.mark.parametrize("hot", [10_000, 0])
def test_substrings_of_repeated_and_null_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_LEAST", hot)
    made = [("a", LONG), ("a", "short one"), ("a", f"before it {LONG} after it"), (None, LONG), (None, None), ("b", " ".join(f"alone{k}" for k in range(90))), ("b", ""), ("b", " ".join(f"alone{k}" for k in range(30))),
            ("c", f"x {LONG[:500]} y"), ("c", f"x {LONG[:500]} y"), *((f"d{k}", f"{k} p q {LONG[200:]} r {k} s") for k in range(70))]
    docs = spark.createDataFrame([(*m, 1, 2, 3) for m in made], "doc_id string, text string, list int, spans int, row int").repartition(3)
    windows = Counter(tuple(w[k:k + 35]) for _, t in made for w in [words(t)] for k in range(len(w) - 34))
    want = Counter()
    for name, text in made:
        w = words(text)
        gone = {i + j for i in range(len(w) - 34) if windows[tuple(w[i:i + 35])] > 1 for j in range(35)}
        want[name, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    out = substrings.substring_dedup(docs)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert Counter(tuple(r) for r in out.collect()) == want


def test_archives_of_repeated_ids(spark):
    made = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (2, "b"), (3, None), (None, "a"), (None, "c"), (4, "c"), (5, "c"), (1, "a")]
    pages = spark.createDataFrame([(k, "u", p, 7, 8) for k, p in made], "id long, url string, payload string, sum int, n int").repartition(2)
    path = scratch_path(spark, "archives")
    warc.write_archives(pages, path)
    first = {p or "": min(k for k, q in made if k is not None and (q or "") == (p or "")) for k, p in made if k is not None}
    want = Counter()
    for k, p in made:
        data = (p or "").encode()
        revisit = k is not None and k > first[p or ""]
        want[k, len(data), warc.payload_digest(data), "revisit" if revisit else "response", str(first[p or ""]) if revisit else None, None if revisit else data] += 1
    got = Counter((r.id and int(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(spark, path).collect())
    assert got == want


def buckets(text):
    parts = regex.findall(quality.PARTS, (text or "").lower())
    one = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    two = [xxhash.xxh64_intdigest(b.encode(), h) for h, b in zip(one, parts[1:])]
    return [h % quality.BUCKETS for h in one + two]  # 2^16 divides 2^64, so the sign of a hash doesn't matter


def test_quality_verdicts_by_brute_force(spark):
    prose = "the calm river runs past nine old mills and people walk along its banks in the evening when the wind is low number"
    shout = "BUY NOW !!! best price !!! click here !!! winner winner !!! free money !!! act today !!! limited offer !!! code"
    made = [*((k, f"{prose} {k} {k * 3}") for k in range(10)), *((100 + k, f"{shout} {k} {k * 5} so go on and buy now") for k in range(10)),
            (3, f"{shout} 3 again and again so buy it"), (None, f"{shout} 50 60 so go on and buy now"), (None, f"{prose} without a name"), (100, f"{prose} under another name"), (5, None), (None, None), (7, ""), (None, f"{prose} without a name")]
    docs = spark.createDataFrame([(*m, "x", 0.5) for m in made], "doc_id long, text string, text_hash string, ratio double").repartition(3)
    label = {**{k: 1 for k in range(6)}, **{100 + k: 0 for k in range(1, 6)}}
    labels = spark.createDataFrame([*label.items(), (None, 0), (1, 1)], "doc_id long, quality int")
    raw, good = Counter(), Counter()
    for k, text in made:
        raw.update(buckets(text))
        if label.get(k) == 1:
            good.update(buckets(text))
    shift = math.log((raw.total() + quality.BUCKETS) / (good.total() + quality.BUCKETS))
    mean = lambda found: sum(round(math.log((good[b] + 1) / (raw[b] + 1)) + shift, 6) for b in found) / len(found) if found else None
    ratio = {m: mean(buckets(m[1])) for m in set(made)}
    judged = [(math.floor(r * 100), label[k]) for (k, _), r in ratio.items() if k in label and r is not None]
    bins = sorted({b for b, _ in judged})
    total = Counter(q for _, q in judged)
    value = lambda cut: sum(q == 1 and b >= cut for b, q in judged) / total[1] + sum(q == 0 and b < cut for b, q in judged) / total[0]
    cuts = [(value(hi), -hi, (hi + lo + 1) / 200) for lo, hi in zip(bins, bins[1:])]
    best = max(cuts)
    limit = best[2] if best[0] > 1 else -math.inf
    out = quality.quality_rules(docs, labels).collect()
    assert len(out) == len(made)
    want = {}
    for m in made:
        n = len(words(m[1]))
        want[m] = (m[0], n, n >= 20 and ratio[m] >= limit, ratio[m])
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3] or 0)
    got = sorted(((r.doc_id, r.n_words, r.kept, r.ratio) for r in out), key=order)
    for a, b in zip(got, sorted((want[m] for m in made), key=order), strict=True):
        assert a[:3] == b[:3] and (a[3] is b[3] is None or abs(a[3] - b[3]) < 1e-5)
    verdict = {(k, (t or "")[:3]): want[k, t][2] for k, t in made}
    assert verdict[100, "BUY"] is False and verdict[100, "the"] is True and verdict[None, "BUY"] is False and verdict[None, "the"] is True
