import itertools
import random

from seqloom.llm import paths
from seqloom.llm.paths import Levels, extend, frequent_paths


def holds(seq, path):
    it = iter(seq)
    return all(x in it for x in path)


def brute(data, share, least, lengths):
    users = {u for u, _ in data if u is not None}
    need = max(least, -(-len(users) * round(share * 1000) // 1000))
    items = sorted({x for _, s in data for x in s or [] if x is not None})
    out = {}
    for n in range(lengths[0], lengths[1] + 1):
        for p in itertools.permutations(items, n):
            c = len({u for u, s in data if u is not None and holds([x for x in s or [] if x is not None], p)})
            if c >= need:
                out[p] = c
    return out


def _run(spark, data, **kw):
    df = spark.createDataFrame([(u, s, 1) for u, s in data], "user_id long, seq array<long>, w int")
    return {tuple(r["path"]): r["n_users"] for r in frequent_paths(df, "user_id", "seq", **kw).collect()}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    data = [(u, [rng.choice([None, 1, 2, 3, 4, 5]) for _ in range(rng.randrange(14))]) for u in range(60)]
    data += data[:10]  # repeated rows
    data += [(3, [1, 2, 3, 4]), (3, [4, 3, 2, 1])]  # users with several rows
    data += [(None, [1, 2, 3, 4])] * 3 + [(70, None), (71, [])]
    want = brute(data, 0.1, 5, (3, 4))
    assert want and _run(spark, data, min_share=0.1, min_users=5) == want
    monkeypatch.setattr(paths, "FLUSH", 3)
    monkeypatch.setattr(paths, "TABLE_BITS", 8)  # nearly all paths share a bit: nothing is pruned, nothing is lost
    assert _run(spark, data, min_share=0.1, min_users=5) == want


def test_extension_rule():
    assert extend([1, 2, 1, 3], Levels(), 2) == {(1, 2), (1, 3), (2, 1), (2, 3)}
    assert extend([1, 2, 3], Levels.of([(1, 2), (2, 3)]), 3) == {(1, 2, 3)}
    assert extend([1, 2, 3], Levels.of([(1, 2)]), 3) == set()


def test_hash_of_columns_and_of_tuples(spark):
    data = [[0, 1], [2, 1, 0], [99_999, 7], [2**31 - 1, 2**31 - 1, 5]]
    got = [r["h"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(data)], "i int, p array<int>").orderBy("i").select(paths._hash_column("p").alias("h")).collect()]
    assert got == [paths.path_hash(tuple(p)) for p in data]


def test_nothing_frequent_and_empty(spark):
    assert _run(spark, [(1, [1, 2, 3])]) == {}
    assert _run(spark, []) == {}


def test_a_hot_user_and_long_sequences(spark):
    data = [(1, [k, k + 1, k + 2]) for k in range(300)] + [(u, list(range(2000))) for u in range(2, 4)] + [(u, [7, 8, 9, 7]) for u in range(4, 10)]
    got = _run(spark, data, min_share=0.5, min_users=6, lengths=(3, 3))
    assert got == {(7, 8, 9): 9, (8, 9, 7): 6}
