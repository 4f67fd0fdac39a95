import random

from seqloom.operators import filters


def _brute(pairs, mu, mi, iterative):
    pairs = set(pairs)
    while True:
        n = len(pairs)
        keep = {i for _, i in pairs if len({u for u, j in pairs if j == i}) >= mu}
        pairs = {(u, i) for u, i in pairs if i in keep}
        keep = {u for u, _ in pairs if len({i for v, i in pairs if v == u}) >= mi}
        pairs = {(u, i) for u, i in pairs if u in keep}
        if not iterative or len(pairs) == n:
            return sorted(pairs)


def test_bipartite_once_and_to_the_fixed_point(spark, rows):
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(170)})
    df = spark.createDataFrame(pairs, "u long, i long")
    once, fixed = _brute(pairs, 6, 6, False), _brute(pairs, 6, 6, True)
    assert once != fixed
    assert sorted(rows(filters.bipartite_kcore(df, "u", "i", 6, 6))) == once
    assert sorted(rows(filters.bipartite_kcore(df, "u", "i", 6, 6, iterative=True))) == fixed
    assert filters.bipartite_kcore(df, "u", "i", 1, 1) is df


def test_one_pass_collapses_what_it_leaves(spark, rows):
    df = spark.createDataFrame([(1, [1, 2, 1, 3, 3]), (2, [1, 1, 3]), (3, None)], "u long, seq array<long>")
    assert rows(filters.kcore_one_pass(df, "u", "seq", k=2, min_len=2)) == [(1, [1, 3]), (2, [1, 3])]


def test_original_counts_apply_at_once(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 3)], "u long, i long")
    assert rows(filters.original_counts_kcore(df, "u", "i", 2, 2)) == [(1, 1)]
    assert rows(filters.item_threshold(df, "i", 2)) == [(1, 1), (2, 1)]


def test_tags(spark, rows):
    t = spark.createDataFrame([(u, 1, "10") for u in range(5)] + [(u, 1, "2") for u in range(5)] + [(1, 1, "7")], "u long, item long, tag string")
    names = spark.createDataFrame([("10", " rock\t"), ("2", "pop"), ("7", "rare"), ("8", "123")], "tag string, name string")
    valid = filters.valid_tags(t, names, "u", "tag", "name")
    assert rows(valid) == [("10", "rock"), ("2", "pop")]
    assert rows(filters.top_tags(t, valid, "item", "tag", "name")) == [(1, 1, "rock"), (1, 2, "pop")]


def test_iterative_kcore_runs_to_the_fixed_point(spark, monkeypatch):
    from seqloom.operators import filters

    # a chain on a small core that loses one item and one user a round, from its end on; a stand-in for the checkpoint keeps it quick
    monkeypatch.setattr(filters, "cut", lambda df: spark.createDataFrame([tuple(r) for r in df.collect()], df.schema).coalesce(1))
    core = [(u, i) for u in (-1, -2) for i in (0, -1)]
    chain = spark.createDataFrame(core + [(u, i) for u in range(104) for i in (u, u + 1)], "u int, i int").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = filters.bipartite_kcore(chain, "u", "i", 2, 2, iterative=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got)) == sorted(core)
