"""Branch starts at forks, against the rule edge by edge."""
import itertools
import random

from routekit.functions.rules import MAIN_SOURCES, is_truncated
from routekit.operators.graph import branch_starts


def brute(edges):
    """For each solid edge with siblings: its fork's main edge is itself if tagged, else the first tagged sibling."""
    out = set()
    solid = [e for e in edges if not e[4]]
    for route, src, dst, source, _ in solid:
        siblings = [e for e in solid if e[:2] == (route, src) and e[2] != dst]
        fork = [(route, src, dst, source)] + [e[:4] for e in siblings]
        main = next((e[2] for e in fork if e[3] in MAIN_SOURCES), None) if siblings else None
        if main is not None:
            out |= {(route, e[2]) for e in fork if e[2] != main}
        else:
            out |= {(route, e[2]) for e in siblings if e[2] == src + 1 or abs(e[2] - src) > 1}
    return out


def test_branch_starts_equal_brute_force(spark):
    rng = random.Random(8)
    edges = [("two", 5, 6, "bifurcation-main", False), ("two", 5, 9, "inferred-label", False), ("same", 1, 2, None, False), ("same", 1, 2, None, False), ("gap", 1, 2, None, False), ("gap", 1, 7, None, True),
             ("back", 4, 3, None, False), ("back", 4, 5, None, False)]
    edges += [(f"r{rng.randint(0, 30)}", (s := rng.randint(1, 8)), s + rng.randint(1, 5), rng.choice([None, None, "other", *MAIN_SOURCES]), rng.random() < 0.15) for _ in range(300)]
    conns = spark.createDataFrame(edges, "route_id string, src int, dst int, source string, gap boolean")
    got = {tuple(r) for r in branch_starts(conns).collect()}
    assert got == brute(edges) and {("two", 6), ("two", 9)} <= got and not any(r in ("same", "gap") for r, _ in got)


def test_truncated_readings(spark):
    pairs = [(n, e) for n, e in itertools.product(range(0, 50), range(0, 120))]
    rows = spark.createDataFrame([*pairs, (None, 60), (5, None)], "n int, e int").select("n", "e", is_truncated("n", "e").alias("hit")).collect()
    want = lambda n, e: n != e and ((n <= 9 and e >= 50 and str(e).endswith(str(n))) or (e - n == 30 and 35 <= n <= 45 and e >= 65) or (e - n == 20 and 25 <= n <= 35 and e >= 45) or (e - n >= 50 and n <= 9 and e >= 50))
    assert all(r.hit == (r.n is not None and r.e is not None and want(r.n, r.e)) for r in rows)
