"""Parentheses, shards and spines of op13 against a plain trie."""
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from routekit.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string"


def test_findclose():
    deal = random.Random(2)
    for n in (1, 2, 5, 40, 700, 5000):
        bits, open_ = [1], 1
        while len(bits) + open_ < 2 * n:
            up = open_ == 1 or deal.random() < deal.choice([0.5, 0.9, 0.52])
            bits.append(int(up))
            open_ += 1 if up else -1
        bits += [0] * open_
        partner, stack = {}, []
        for at, bit in enumerate(bits):
            stack.append(at) if bit else partner.__setitem__(stack.pop(), at)
        p = prefixes.Parens(np.array(bits, dtype=np.uint8))
        assert p.findclose(p.opens).tolist() == [partner[at] for at in p.opens]
        size, leaves = p.subtrees()
        assert size.tolist() == [sum(bits[at:partner[at]]) for at in p.opens]
        assert leaves.tolist() == [sum(bits[k] > bits[k + 1] for k in range(at, partner[at])) for at in p.opens]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    seq = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    made = {c: seq.get(c - int(np.fmod(c, 20)), [])[:(h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in seq.items()}
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    def below(p):
        leaves, saved, todo = 0, 0, [p]
        while todo:
            q = todo.pop()
            leaves += not kids[q]
            saved += (len(members[q]) - 1) * (len(q[-1][1].split()) if q else 0)
            todo += kids[q]
        return leaves, saved
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), *below(p), hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def trie(spark, rows, shards):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = prefixes.prefix_trie(prefixes.rebuilt(prefixes.paths(frame)), shards).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in found)


def test_trie(spark):
    deal = random.Random(7)
    rows = []
    for c in range(400):
        kind = deal.random()
        if kind < 0.35:
            turns = [("user", "the common one"), ("assistant", "a b c"), ("user", "d")]  # a third are copies
        elif kind < 0.45:
            turns = [("user", "the common one")] + [("assistant", "a b c")] * deal.randint(0, 9)
        else:
            turns = [(deal.choice(["user", None, ""]), deal.choice(["x", "y z", None, "", "u\nv w"])) for _ in range(deal.randint(0, 6))]
        rows += [(c if c % 7 else c + 1000, k, r, t, "d", "k") for k, (r, t) in enumerate(turns)]
    odd = [(30, None, "user", "first"), (31, 5, "user", "tie a"), (31, 5, "user", "tie b"), (31, 5, "user", "tie b"), (None, 1, "user", "no one"), (-5, 1, "user", "negative"), (-25, 1, "user", "negative")]
    rows += [(*r, "d", "k") for r in odd]
    rows += [(5000, k, "user", f"turn {k % 3}", "d", "k") for k in range(500)] + [(5020, k, "user", f"turn {k % 3}", "d", "k") for k in range(480)]
    want = plain(rows)
    for shards in (1, 3, 40):
        assert trie(spark, rows, shards) == want


def test_odd_tables(spark):
    assert trie(spark, [], 3) == []
    assert trie(spark, [(None, 1, "user", "x", "d", "k")], 3) == []
    one = [(1, 1, None, None, "d", "k")]  # crc32 of 1 leaves turns out
    assert trie(spark, one, 3) == plain(one)
    long = [(c, k, "user", "word " * 50_000, "d", "k") for c in (20, 21) for k in range(4)]
    assert trie(spark, long, 2) == plain(long)
