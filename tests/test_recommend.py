import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import assembly, graph, metrics, ranking
from seqloom.plans import recommend as rec
from tests.test_graph import brute_rings


def fold(picks, budgets, already=()):
    res, over = [], []
    for p, k in zip(picks, budgets):
        p = [x for x in p if x not in already and x not in res and x not in over]
        t = min(len(over), max(0, k - len(p)))
        res += over[:t] + p[: k - t]
        over = over[t:] + p[k - t :]
    return res + over[: sum(budgets) - len(res)]


@pytest.mark.parametrize("picks,budgets,want", [([[1, 2, 3], [4]], (1, 2), [1, 4, 2]), ([[1], [2, 3, 4]], (2, 1), [1, 2, 3]), ([[], []], (2, 1), []), ([[1, 2], None], (1, 1), [1, 2])])
def test_fold(spark, picks, budgets, want):
    df = spark.createDataFrame([(picks,)], "picks array<array<long>>")
    got = assembly.assemble(df, "picks", budgets).first()["items"]
    assert sorted(got) == sorted(want) and got == fold([p or [] for p in picks], budgets)


def test_fold_random(spark):
    rng = random.Random(5)
    data = [([[x for x in rng.sample(range(12), rng.randrange(5))] for _ in range(3)], rng.sample(range(12), 2)) for _ in range(60)]
    df = spark.createDataFrame([(i, p, a) for i, (p, a) in enumerate(data)], "q long, picks array<array<long>>, al array<long>")
    for r in assembly.assemble(df, "picks", (3, 2, 1), already="al").collect():
        want = fold(r["picks"], (3, 2, 1), r["al"])
        assert r["items"] == want and len(set(want)) == len(want) <= 6


def naive(seqs, vectors, cfg, method, n_items):
    """Plain Python from the definitions."""
    counts = {}
    for s in seqs.values():
        for a, b in zip(s[:-2], s[1:-2]):
            counts[a, b] = counts.get((a, b), 0) + 1
    top = {}
    for (a, _), c in counts.items():
        top[a] = max(top.get(a, 0), np.log1p(c))
    vertices = sorted({x for e in counts for x in e})
    vec = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    zero = np.zeros(len(next(iter(vectors.values()))))
    budgets = (cfg.budgets,) if method == "single" else (cfg.budgets2, cfg.budgets3)
    depth = max(cfg.max_hops, *map(len, budgets))
    depth = min(depth, cfg.explicit_depth or depth)
    rings = brute_rings(counts, depth)

    def cosine(anchor, i):
        return float(anchor @ vec.get(i, zero))

    def outside(src, anchor, history, k, taken=()):
        gone = {src, *history, *taken} | {i for s, _, i in rings if s == src}
        sc = sorted((-round(cosine(anchor, i), 9) + 0.0, i) for i in range(n_items) if i not in gone)
        return [i for _, i in sc][:k]

    def ranked(src, anchor, history, n, k, taken=()):
        out = []
        for h in range(1, min(depth, n) + 1):
            sc = []
            for s, hh, i in rings:
                if s == src and hh == h and i not in taken:
                    sc.append((-round(cosine(anchor, i) + (cfg.alpha * np.log1p(counts[src, i]) / top[src] if h == 1 else 0), 9), i))
            out.append([i for _, i in sorted(sc)][:k])
        return out + [outside(src, anchor, history, k, taken)] * (n > depth) + [[]] * (n - depth - 1)

    def pad(uid, items, total, taken=()):
        n, out = len(vertices), list(items)
        p = assembly.next_prime(n)
        h = hashlib.md5(f"{cfg.seed}:{uid}".encode()).hexdigest()
        a, b = int(h[:12], 16) % p, int(h[12:24], 16) % (p - 1) + 1
        for j in range(p):
            at = (a + j * b) % p
            if len(out) < total and at < n and vertices[at] not in out and vertices[at] not in taken:
                out.append(vertices[at])
        return out

    def topped(items, more, total, taken=()):
        return items + [x for x in more if x not in items and x not in taken][: max(0, total - len(items))]

    def mean(items):
        m = sum((vec.get(i, zero) for i in items), zero) / len(items)
        return m / max(np.linalg.norm(m), 1e-8)

    out = {}
    for u, s in seqs.items():
        history = s[:-1]
        if method == "single":
            k, anchor = sum(cfg.budgets), mean(history[-cfg.last_n :])
            items = fold(ranked(s[-2], anchor, history, len(cfg.budgets), k), cfg.budgets)
            if cfg.semantic_pad:
                items = topped(items, outside(s[-2], anchor, history, k), k)
            out[u] = pad(u, items, k)
            continue
        k2, k3 = sum(cfg.budgets2), sum(cfg.budgets3)
        anchor2 = vec.get(s[-2], zero)
        a = fold(ranked(s[-2], anchor2, history, len(cfg.budgets2), k2), cfg.budgets2)
        more = outside(s[-2], anchor2, history, k2) if cfg.semantic_pad else []
        a = pad(u, topped(a, more, k2), k2)
        b = []
        if len(history) > 1:
            anchor3 = vec.get(s[-3], zero)
            b = fold(ranked(s[-3], anchor3, history, len(cfg.budgets3), k3, a), cfg.budgets3, a)
            if cfg.semantic_pad:
                b = topped(b, outside(s[-3], anchor3, history, k3, a), k3, a)
            b = pad(u, b, k3, a)
        out[u] = pad(u, topped(a + b, more, k2 + k3), k2 + k3)
    return out


@pytest.mark.parametrize(
    "method,n_items,cfg",
    [
        ("single", 14, rec.Config()),
        ("single", 40, rec.Config(last_n=3)),
        ("single", 40, rec.Config(explicit_depth=1, seed=7)),
        ("single", 40, rec.Config(explicit_depth=2, last_n=2)),
        ("single", 30, rec.Config(max_hops=1, budgets=(9,), semantic_pad=True)),
        ("two", 14, rec.Config()),
        ("two", 40, rec.Config()),
        ("two", 40, rec.Config(explicit_depth=1)),
        ("two", 40, rec.Config(max_hops=1, budgets2=(6,), budgets3=(5,), semantic_pad=True)),
    ],
)
def test_methods_against_plain_python(spark, method, n_items, cfg):
    rng = random.Random(n_items)
    seqs = {u: [rng.randrange(n_items) for _ in range(rng.randrange(3, 8))] for u in range(14)}
    vectors = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(n_items) if i % 5}
    df = spark.createDataFrame(list(seqs.items()), "user_id long, seq array<long>")
    v = rec.unit_vectors(spark.createDataFrame([(i, x) for i, x in vectors.items()], "i long, x array<double>"), "i", "x")
    got = (rec.single_source if method == "single" else rec.two_source)(df, graph.transitions(df, "seq"), v, cfg, n_items)
    assert {r["user_id"]: r["items"] for r in got.collect()} == naive(seqs, vectors, cfg, method, n_items)


def test_short_histories_in_the_two_source_method(spark):
    """Users with a single history item have no second source and are padded in its place."""
    seqs = {1: [3, 4], 2: [3, 4, 5, 6, 7], 3: [9, 9]}
    df = spark.createDataFrame(list(seqs.items()), "user_id long, seq array<long>")
    v = rec.unit_vectors(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)], "i long, x array<double>"), "i", "x")
    for cfg in (rec.Config(), rec.Config(max_hops=1, budgets2=(3,), budgets3=(2,), semantic_pad=True)):
        got = rec.two_source(df, graph.transitions(df, "seq"), v, cfg, 10)
        assert {r["user_id"]: r["items"] for r in got.collect()} == naive(seqs, {i: [1.0, float(i)] for i in range(10)}, cfg, "two", 10)


def test_semantic_pad_avoids_history_and_visited(spark):
    df = spark.createDataFrame([(1, [0, 1, 2, 1, 5])], "user_id long, seq array<long>")
    v = rec.unit_vectors(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)], "i long, x array<double>"), "i", "x")
    cfg = rec.Config(budgets=(4,), max_hops=1, semantic_pad=True)
    got = rec.single_source(df, graph.transitions(df, "seq"), v, cfg, n_items=8).first()["items"]
    assert got[:1] == [2] and len(got) == 4 and not set(got[1:]) & {0, 1, 2}
    assert got[1:] == [3, 4, 5]


@pytest.mark.parametrize("block,chunk", [(65_536, 4096), (7, 3)])
def test_complement_against_brute_force(spark, block, chunk):
    rng = np.random.default_rng(5)
    v = {i: rng.integers(-2, 3, 3).astype(float) for i in range(40) if i % 4}  # many ties
    queries = {q: None if q == 4 else rng.integers(-2, 3, 3).astype(float) for q in range(20)}
    gone = {(int(q), int(i)) for q, i in zip(rng.integers(0, 20, 200), rng.integers(-3, 60, 200))} | {(9, i) for i in range(50)}
    got = ranking.complement_top(
        spark.createDataFrame([(q, None if a is None else a.tolist()) for q, a in queries.items()], "q long, anchor array<double>"),
        spark.createDataFrame(list(gone), "q long, item long"),
        spark.createDataFrame([(i, e.tolist()) for i, e in v.items()] + [(99, [1.0, 1.0, 1.0])], "item long, e array<double>"),
        50, 6, block, chunk,
    )
    lists = {}
    for r in got.orderBy("q", "rank").collect():
        lists.setdefault(r["q"], []).append(r["item"])
    for q, a in queries.items():
        want = sorted((-(0.0 if a is None else float(a @ v.get(i, np.zeros(3)))) + 0.0, i) for i in range(50) if (q, i) not in gone)
        assert lists.get(q, []) == [i for _, i in want][:6]


def test_walks_come_past_every_vertex(spark):
    pool, n = assembly.pad_pool(spark.createDataFrame([(i * 3,) for i in range(10)] + [(None,), (0,)], "item long"))
    short = spark.createDataFrame([(q, [0, 3, 999]) for q in range(30)], "q long, items array<long>")
    got = {r["q"]: r["pad"] for r in assembly.random_pad(short, pool, n, 20, 1, "items").collect()}
    assert n == 10 and all(sorted(x) == list(range(6, 30, 3)) for x in got.values()) and len({tuple(x) for x in got.values()}) > 20
    assert {len(r["pad"]) for r in assembly.random_pad(short, pool, n, 5, 1, "items").collect()} == {2}


def test_metrics(spark):
    df = spark.createDataFrame([([7, 9, 5], 9), ([1], 2)], "items array<long>, target long")
    m = {r["k"]: (r["recall"], round(r["ndcg"], 5)) for r in metrics.ranking_metrics(df, "items", "target", (1, 5)).collect()}
    assert m == {1: (0.0, 0.0), 5: (0.5, round(0.6309297 / 2, 5))}
    p = rec.predictions(df.withColumn("user_id", F.lit(1)), 2).collect()
    assert p[0]["item_ids"] == [7, 9] and p[0]["gt_ids"] == [9]


@pytest.mark.parametrize("round_bytes,shift", [(1 << 30, 0), (1 << 30, 1 << 41), (2000, 0)])
def test_two_rings_in_rounds(spark, monkeypatch, round_bytes, shift):
    """Sources with and without a vector, in one round and in many, small ids and large ones."""
    monkeypatch.setattr(rec, "ROUND_BYTES", round_bytes)
    rng = random.Random(4)
    seqs = {u: [shift + min(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(3, 12))] for u in range(40)}
    vectors = {shift + i: [rng.gauss(0, 1) for _ in range(4)] for i in range(30) if i % 3 == 0}
    df = spark.createDataFrame(list(seqs.items()), "user_id long, seq array<long>")
    v = rec.unit_vectors(spark.createDataFrame(list(vectors.items()), "i long, x array<double>"), "i", "x")
    for cfg in (rec.Config(budgets=(3, 2)), rec.Config(budgets=(2, 6), alpha=0.0)):
        got = rec.single_source(df, graph.transitions(df, "seq"), v, cfg)
        assert {r["user_id"]: r["items"] for r in got.collect()} == naive(seqs, vectors, cfg, "single", 0)


def test_pairs_of_the_second_ring_are_not_kept(spark, monkeypatch):
    """What is kept on disk grows with edges and lists, not with the pairs that are reached."""
    kept = []
    for m in (rec, graph):
        monkeypatch.setattr(m, "cut", lambda df, real=m.cut: kept.append(real(df)) or kept[-1])
    seqs = {u: [u % 50, 50 + u // 50, 0] for u in range(2500)} | {10_000 + u: [50 + u % 50, 100 + u // 50, u % 50, 0] for u in range(2500)}
    df = spark.createDataFrame([(u, [*s, 1]) for u, s in seqs.items()], "user_id long, seq array<long>")
    v = rec.unit_vectors(spark.createDataFrame([(1, [1.0])], "i long, x array<double>"), "i", "x")
    edges = graph.transitions(df, "seq", 1)
    got = rec.single_source(df.withColumn("seq", F.array(F.col("seq")[0], F.col("seq")[0], F.lit(1))), edges, v, rec.Config(budgets=(8, 2)))
    assert got.count() == 5000 and max(x.count() for x in kept if "item" in x.columns) <= 101 * 20


def test_a_source_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        edges = spark.createDataFrame([(0, i, 1) for i in range(60)] + [(i, (i * 7 + j) % 90, 2) for i in range(1, 60) for j in range(9)], "src long, dst long, cnt long")
        lists = graph.packed(edges)
        assert sorted(map(tuple, graph.unpacked(lists).collect())) == sorted(map(tuple, edges.collect()))
        roots = spark.createDataFrame([(0, False), (1, True), (2, False), (99, True)], "src long, hot boolean")
        got = {}
        for r in graph.reached_twice(lists, lists.join(roots, "src"), roots, 4).collect():
            got.setdefault(r["src"], []).append(r["item"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_rings({(r["src"], r["dst"]): r["cnt"] for r in edges.collect()}, 2)
    for s, n in ((0, 4), (1, 999), (2, 4)):
        assert sorted(got[s]) == sorted(i for x, h, i in want if (x, h) == (s, 2))[:n]
    assert set(got) == {0, 1, 2}
