import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import queries
from seqloom.llm.similar_pairs import bucket_of, close_within, pairs_at, rotations, similar_pairs, tables_needed


def _frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, embedding array<float>")


def _brute(v, least):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= least, 1))
    return set(zip(i.tolist(), j.tolist()))


def test_more_partners_than_a_list_holds(spark, monkeypatch):
    """All pairs count, also of items that have over ten near ones."""
    rng = np.random.default_rng(3)
    v = (rng.normal(size=64) + 0.05 * rng.normal(size=(30, 64))).astype(np.float32)
    df = _frame(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = [tuple(r) for r in queries.p1_found(spark, "").collect()]
    assert len(got) == len(set(got)) == 30 * 29 // 2 and set(got) == _brute(v, 0.9)


def test_tables_bring_pairs_at_the_bound_together(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 64)) + 0.4
    base = (base / np.linalg.norm(base, axis=1, keepdims=True)).astype(np.float32)
    a, b = pairs_at(base, 0.9, 1500)
    assert np.allclose((a * b).sum(1), 0.9, atol=1e-5)
    v = np.concatenate([a, b, b[:5]]) * rng.uniform(0.1, 9.0, (3005, 1)).astype(np.float32)
    out = similar_pairs(_frame(spark, [(i, x.tolist()) for i, x in enumerate(v)] * 2), "item_id", "embedding", 0.9, whole=500, bucket=100).collect()
    got, want = {tuple(r) for r in out}, _brute(v, 0.9)
    assert len(out) == len(got) and got <= want | _brute(v, 0.9 - 1e-9) and len(got & want) >= 0.995 * len(want) > 700


def test_number_of_tables():
    x = np.random.default_rng(6).normal(size=(2000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    counts = [tables_needed(x, n, 0.9, x.mean(0)) for n in (4096, 100_000, 10_000_000)]
    assert counts == sorted(counts) and counts[0] < counts[-1] < 64
    assert len(set(bucket_of(x, rotations(2000, 16, 0, 100)).tolist())) >= 18
    assert bucket_of(x, rotations(100, 16, 0, 100)).max() == 0


def test_blocks_of_a_bucket():
    x = np.ones((50, 2), np.float32)
    for block in (1, 7, 64):
        got = [p for i, j in close_within(x, 1.5, block) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) == 50 * 49 // 2 and all(i < j for i, j in got)


@pytest.mark.parametrize("n", [0, 1])
def test_few(spark, n):
    df = _frame(spark, [(1, [1.0, 0.0]), (2, [1e30, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (None, [1.0, 0.0])])
    rows = similar_pairs(df if n else df.limit(0), "item_id", "embedding", 0.9).collect()
    assert [tuple(r) for r in rows] == [(1, 2)] * n
    assert similar_pairs(df.filter(F.col("item_id") > 2), "item_id", "embedding", 0.9).collect() == []


def test_sample_by_hash(spark):
    """The rows with the least hashes, as if all were sorted, and few of the others are gathered."""
    from seqloom.llm.neighbours import hashed_sample

    df = spark.range(20_000).withColumnRenamed("id", "k")
    want = [r["k"] for r in df.orderBy(F.xxhash64("k")).limit(50).collect()]
    assert [r["k"] for n in (20_000, 10) for r in hashed_sample(df, n, 50).collect()] == want * 2
    assert hashed_sample(df.filter("k < 60"), 20_000, 50).count() == 50  # far fewer rows than stated
