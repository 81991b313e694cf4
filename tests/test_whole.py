"""Operators over whole tables, where there is no SQL, against brute force."""

from __future__ import annotations

import itertools
import random
import time

import duckdb

from skarn.operators import agreement, graph
from skarn.plans import catalogue
from skarn.session import checkpointed

SF = "/root/testdata/sf0.001"


def near_pairs(sets):
    out = []
    for a in sets:
        for b in sets:
            shared, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and shared >= 2 and 3 * shared >= 2 * both and shared < both:
                out.append((a, b, shared))
    return sorted(out)


def test_near_sets_equal_brute_force(spark):
    rng = random.Random(3)
    sets = {i: {f"i{rng.randrange(9)}" for _ in range(rng.randint(1, 9))} for i in range(120)}
    rows = [(s, x) for s, items in sets.items() for x in items for _ in range(rng.randint(1, 2))]
    got = sorted(tuple(r) for r in agreement.near_sets(spark.createDataFrame([*rows, (None, "i1"), (1, None)], "site bigint, item string")).collect())
    assert got == near_pairs(sets) and got


def test_all_orders_are_paired(spark):
    tables = {x: f"'{SF}/{x}.parquet'" for x in ("orders", "lineitem", "part")}
    sets = {}
    for site, item in duckdb.sql("SELECT o_custkey, p_brand FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey".format(**tables)).fetchall():
        sets.setdefault(site, set()).add(item)
    got = sorted(tuple(r) for r in catalogue.queries()["dispatch_disagreement"](spark, SF).collect())
    assert got == near_pairs(sets) and len(got) > 1000


def depths(edges, seeds):
    seen, front = {s: 0 for s in seeds}, set(seeds)
    while front:
        front = {b for a, b in edges if a in front} - seen.keys()
        seen |= dict.fromkeys(front, max(seen.values()) + 1)
    return seen


def components(edges):
    reached = {n: set(depths(edges, {b for a, b in edges if a == n})) for e in edges for n in e}
    return {n: min(m for m in reached[n] if n in reached[m]) for n in reached if n in reached[n]}


def cycle_length(edges, members, node):
    inner = {(a, b) for a, b in edges if members.get(a) == members.get(b) == members[node]}
    return 1 + depths(inner, {b for a, b in inner if a == node})[node]


def held(spark, edges):
    """All graph operators on these edges against brute force."""
    members = components(edges)
    df = spark.createDataFrame(sorted(edges), "src bigint, dst bigint").repartition(3)
    got = checkpointed(graph.strong_components(df))
    assert sorted(map(tuple, got.select("node", "component").collect())) == sorted(members.items())
    paths = {r.component: r.path for r in graph.shortest_cycle(df, got).collect()}
    assert {c: len(p) - 1 for c, p in paths.items()} == {c: cycle_length(edges, members, c) for c in set(members.values())}
    assert all(p[0] == p[-1] == c and set(itertools.pairwise(p)) <= edges for c, p in paths.items())
    seeds = sorted({n for e in edges for n in e if n % 5 == 0})
    depth = graph.reach(df, spark.createDataFrame([(n,) for n in [*seeds, seeds[0]]], "node bigint")).collect()
    assert {r.node: r.depth for r in depth} == depths(edges, seeds) and len(depth) == len({r.node for r in depth})
    return paths


def test_graph_operators_equal_brute_force(spark):
    """Small dense parts with bridges; sparse random graphs with long chains, loops, rings and trees."""
    rng = random.Random(4)
    dense = {(400 + 6 * g + rng.randrange(6), 400 + 6 * g + rng.randrange(6)) for g in range(4) for _ in range(9)} | {(402, 407), (408, 413), (403, 420)}
    sparse = {(rng.randrange(150), rng.randrange(150)) for _ in range(190)}
    order = rng.sample(range(200, 260), 60)
    rings = set(itertools.pairwise([*order[:25], order[0]])) | set(itertools.pairwise([*order[25:], order[25]]))
    several = {(500, 509), (509, 508), (508, 500), (500, 503), (503, 507), (507, 500), (500, 502), (502, 505), (505, 506), (506, 500), (510, 512), (512, 510), (512, 512)}
    paths = held(spark, dense | sparse | rings | several | {(order[3], 0), (5, order[30]), (300, 300), (301, 302), (302, 303), (order[7], order[7])})
    # Of cycles of one length the first in node order, also where chains are contracted.
    assert paths[500] == [500, 503, 507, 500] and paths[510] == [510, 512, 510]


def test_long_ring(spark):
    """A ring of 1,000 nodes in no order takes a few rounds, not one a node."""
    order = random.Random(6).sample(range(1000), 1000)
    edges = list(itertools.pairwise([*order, order[0]]))
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    began = time.time()
    members = checkpointed(graph.strong_components(df))
    assert {(r.node, r.component) for r in members.collect()} == {(n, 0) for n in range(1000)}
    (cycle,) = graph.shortest_cycle(df, members).collect()
    assert set(itertools.pairwise(cycle.path)) == set(edges) and cycle.path[0] == 0
    assert time.time() - began < 60
    depth = {r.node: r.depth for r in graph.reach(df, spark.createDataFrame([(order[0],)], "node bigint")).collect()}
    assert depth == {n: i for i, n in enumerate(order)}
