import math
import random

import pytest

from seqloom.operators import graph


def brute_rings(edges, depth):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    out = set()
    for s in adj:
        ring, visited = set(adj[s]), {s} | adj[s]
        for h in range(1, depth + 1):
            out |= {(s, h, x) for x in ring}
            ring = {c for b in ring for c in adj.get(b, ())} - visited
            visited |= ring
    return out


def test_worked_example_keeps_self_loops(spark, rows):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 1, 1)], "src long, dst long, cnt long")
    ring, visited = graph.rings(e, spark.createDataFrame([(1,)], "src long"), 3)
    assert rows(ring) == [(1, 1, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4)]
    assert rows(visited) == [(1, 1), (1, 2), (1, 3), (1, 4)]


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(15), rng.randrange(15)) for _ in range(28)}
    e = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, cnt long")
    ring, visited = graph.rings(e, depth=3)
    got = {tuple(r) for r in ring.collect()}
    assert got == brute_rings(edges, 3)
    assert len(got) == ring.count()
    assert {tuple(r) for r in visited.collect()} == {(s, x) for s, _, x in got} | {(a, a) for a, _ in edges}


def test_transitions_and_weights(spark, rows):
    s = spark.createDataFrame([([1, 2, 2, 1, 9, 9],), ([1, 2, 8, 8],)], "seq array<long>")
    t = graph.transitions(s, "seq")
    assert rows(t) == [(1, 2, 2), (2, 1, 1), (2, 2, 1)]
    e = spark.createDataFrame([(1, 2, 3), (1, 3, 1), (4, 5, 0)], "src long, dst long, cnt long")
    w = {(r["src"], r["dst"]): r["w"] for r in graph.edge_weights(e).collect()}
    assert w[1, 2] == 1.0 and math.isclose(w[1, 3], 0.5) and w[4, 5] == 0.0
    assert rows(graph.vertices(e)) == [(1,), (2,), (3,), (4,), (5,)]


def test_shards_add_up(spark, rows):
    r = spark.createDataFrame([(0, 1, 2, 3), (0, 1, 2, 3), (1, 1, 2, 1), (1, 1, 2, None), (0, None, 2, 1)], "shard int, src long, dst long, n long")
    assert rows(graph.from_shards(r, "src", "dst", "n")) == [(1, 2, 4)]


def test_sizes_outside_of_rings_and_history(spark, rows):
    users = spark.createDataFrame([(1, 0, [2, 2, 1]), (2, 7, []), (3, 0, [9])], "user long, src long, history array<long>")
    visited = spark.createDataFrame([(0, 0), (0, 1), (0, 1)], "src long, item long")
    assert rows(graph.outside_sizes(users, visited, 4)) == [(1, 1), (2, 4), (3, 2)]


def test_hubs_are_spread(spark, rows, monkeypatch):
    edges = {(a, 0) for a in range(1, 30)} | {(0, b) for b in range(30, 60)} | {(5, 6)}
    monkeypatch.setattr(graph, "HUB", 4)
    ring, _ = graph.rings(spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, cnt long"), depth=3)
    assert {tuple(r) for r in ring.collect()} == brute_rings(edges, 3)


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src long, dst long, cnt long")
    ring, visited = graph.rings(e, depth=2)
    assert ring.count() == 0 and visited.count() == 0
