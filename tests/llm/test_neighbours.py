import numpy as np
import pytest

from seqloom.llm.hnsw import Graph
from seqloom.llm.neighbours import centroid_tree, closest_cells, fit_cells, nearest_neighbours


def _brute(v, k):
    s = v @ v.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, 1, kind="stable")[:, :k]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, embedding array<float>, rank string, cells int")  # extra columns clash with internal names


def test_graph_recall_and_flat_form():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = Graph.load(Graph.build(v).dump())
    ids, sims = g.search(v, 11, 64)
    want = _brute(v, 10)
    assert np.mean([len(set(want[i]) & set(ids[i])) / 10 for i in range(len(v))]) > 0.97
    assert np.allclose(sims[:, 0], 1, atol=1e-5) and (np.diff(sims, axis=1) <= 0).all()
    for nodes, nbrs in g.layers:
        assert nbrs.shape[0] == len(nodes) and nbrs.max() < len(nodes)
        for row in nbrs[:200]:
            own = row[row >= 0]
            assert len(set(own)) == len(own)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_tiny_graphs(n):
    v = np.eye(5, dtype=np.float32)[:n]
    ids, _ = Graph.build(v).search(v, 4, 8)
    assert [set(r[r >= 0]) for r in ids] == [set(range(n)) if n <= 4 else set(r[r >= 0]) for r in ids]


def test_tree_is_balanced():
    x = np.random.default_rng(1).normal(size=(1000, 4)).astype(np.float32)
    assert centroid_tree(x, 6).shape == (6, 4)
    assert len(centroid_tree(np.ones((50, 3), np.float32), 4)) == 4


@pytest.mark.parametrize("shard,probes", [(100_000, 4), (150, 3)])
def test_recall_against_brute_force(spark, shard, probes):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 12))
    v = (centres[rng.integers(0, 12, 900)] + 0.5 * rng.normal(size=(900, 12)) + 1).astype(np.float32)
    df = _frame(spark, [(i, x.tolist(), None, None) for i, x in enumerate(v)] * 2)
    got = {}
    for r in nearest_neighbours(df, "item_id", "embedding", shard_vectors=shard, probes=probes).collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["neighbour"], r["cosine"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = _brute(u, 10)
    assert all([x[0] for x in sorted(g)] == list(range(1, 11)) for g in got.values())
    assert all(i not in [x[1] for x in g] for i, g in got.items())
    assert np.mean([len(set(want[i]) & {x[1] for x in got[i]}) / 10 for i in range(900)]) >= 0.9


def test_recall_does_not_fall_with_the_number_of_cells(spark):
    v = np.random.default_rng(4).normal(size=(3000, 48)).astype(np.float32)
    out = nearest_neighbours(_frame(spark, [(i, x.tolist(), None, None) for i, x in enumerate(v)]), "item_id", "embedding", shard_vectors=100).collect()  # 30 cells
    want = _brute(v / np.linalg.norm(v, axis=1, keepdims=True), 10)
    assert sum(r["neighbour"] in want[r["item_id"]] for r in out) / want.size >= 0.9


def test_unusable_vectors_copies_and_order(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0])]
    out = nearest_neighbours(_frame(spark, [(*r, None, None) for r in rows]), "item_id", "embedding").collect()
    assert sorted((r["item_id"], r["rank"], r["neighbour"]) for r in out) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]


def test_many_copies_of_one_vector(spark):
    df = _frame(spark, [(i, [0.6, 0.8], None, None) for i in range(60)] + [(100, [1.0, 0.0], None, None)])
    got = {}
    for r in nearest_neighbours(df, "item_id", "embedding", k=3).collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["neighbour"]))
    for i in range(60):
        assert [x for _, x in sorted(got[i])] == [j for j in range(5) if j != i][:3]
    assert [x for _, x in sorted(got[100])] == [0, 1, 2]


def test_empty(spark):
    assert nearest_neighbours(_frame(spark, []), "item_id", "embedding").collect() == []
    assert nearest_neighbours(_frame(spark, [(1, None, None, None)]), "item_id", "embedding").collect() == []
    assert nearest_neighbours(_frame(spark, [(1, [1.0], None, None)]), "item_id", "embedding").collect() == []


def test_cells_of_two_levels(spark):
    """More cells than one sample can feed: a tree below each cell of the first, and cells of like size."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(4000, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "k long, v binary")
    c = fit_cells(index, 4000, 8, 100, sample=256)
    assert c.shape[1] == 8 and 36 <= len(c) <= 60
    sizes = np.bincount(closest_cells(v, c, 1)[:, 0], minlength=len(c))
    assert sizes.max() < 400
    want = np.argsort(0.5 * (c**2).sum(1) - v @ c.T, axis=1, kind="stable")[:, :5]
    assert (closest_cells(v, c, 5) == want).mean() > 0.999
    assert len(fit_cells(index, 4000, 8, 1000, sample=256)) == 4
