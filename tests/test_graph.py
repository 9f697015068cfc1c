"""The graph operators against brute-force versions on small tables."""

import random
from collections import defaultdict


def _roots(edges):
    children = defaultdict(set)
    for a, b in edges:
        children[a].add(b)
    blocked = {b for _, b in edges}
    out = {}
    for root in [a for a in children if a not in blocked] or list(children):
        seen, todo = {root}, [root]
        while todo:
            for b in children.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[root] = len(seen) - 1
    return out


def test_lock_roots_counts_all_descendants(spark):
    from tidemark.operators.graph import lock_roots

    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(9)]
    diamond = [(20, 21), (20, 22), (21, 23), (22, 23), (23, 21)]
    cycle = [(1, 2), (2, 3), (3, 1), (3, 4)]
    for edges in (chain + diamond, cycle, list({(rng.randrange(60), rng.randrange(60)) for _ in range(70)})):
        got = lock_roots(spark.createDataFrame(edges, "blocker long, blocked long")).collect()
        assert {r.root: r.affected for r in got} == _roots(edges) and len(got) == len(_roots(edges))
    assert lock_roots(spark.createDataFrame([], "blocker long, blocked long")).count() == 0


def test_lock_roots_make_no_pairs_of_all_nodes(spark, monkeypatch):
    """Two knots of 60 with ways between, beside, in and out: each blocker a root, or some of them."""
    from tidemark.operators import graph

    rng, made, whole = random.Random(5), [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda *a: (found := whole(*a), made.append(found.count()))[0])
    knots = [(at + rng.randrange(60), at + rng.randrange(60)) for at in (0, 100) for _ in range(300)]
    knots += [(at + i, at + (i + 1) % 60) for at in (0, 100) for i in range(60)] + [(7, 200), (200, 201), (201, 107), (109, 202), (300, 301), (301, 300), (301, 5)]
    ways = [(400 + i, rng.choice((i, 100 + i, 202, 400 + i + 1))) for i in range(20)] + [(400, 430), (430, 202), (431, 432), (432, 202)]
    for edges in (knots, knots + ways, ways):
        made.clear()
        got = graph.lock_roots(spark.createDataFrame(edges, "blocker long, blocked long")).collect()
        assert {r.root: r.affected for r in got} == _roots(edges) and len(got) == len(_roots(edges))
        assert sum(made) < 300


def test_waits_take_every_order(spark):
    from tidemark.operators.graph import waits

    rng = random.Random(4)
    orders = [(k, rng.randrange(8), f"day{rng.randrange(3)}", f"p{rng.randrange(2)}") for k in range(60)]
    want, last = set(), {}
    for k, c, day, p in orders:
        if last.get((day, p), c) != c:
            want.add((last[day, p], c))
        last[day, p] = c
    got = waits(spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_supply_paths_take_single_lines(spark):
    from tidemark.operators.graph import supply_paths

    rng = random.Random(6)
    lines = [(rng.randrange(6), rng.randrange(9)) for _ in range(40)] + [(6, 2)]
    total, links, want = defaultdict(int), defaultdict(int), defaultdict(list)
    for s, p in lines:
        total[s] += 1
        links[s, p] += 1
    for s, p in links:
        for s2, p2 in links:
            if p == p2 and s < s2:
                want[s, s2].append(min(links[s, p] / total[s], links[s2, p] / total[s2]))
    got = {(r.s1, r.s2): (r.confidence, r.paths) for r in supply_paths(spark.createDataFrame(lines, "l_suppkey long, l_partkey long")).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == len(v) and abs(got[k][0] - max(max(v) - 0.05, 0)) < 0.00501 for k, v in want.items())
