import itertools
import random
from collections import Counter

import pytest

from seqloom.llm import cooccurrence as co
from seqloom.llm.cooccurrence import pair_lift


def brute(data, least, lift=None):
    users = {u for u, _ in data if u is not None}
    sets = {}
    for u, s in data:
        if u is not None:
            sets.setdefault(u, set()).update(x for x in s or [] if x is not None)
    n1 = Counter(x for s in sets.values() for x in s)
    n2 = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    n = len(users)
    return {(a, b): (c, n1[a], n1[b], n) for (a, b), c in n2.items() if c >= least and (lift is None or c * n >= lift * n1[a] * n1[b])}


@pytest.mark.parametrize("sizes", [(131_072, 256), (3, 1)])
@pytest.mark.parametrize("lift", [None, 1.4])
def test_against_brute_force(spark, monkeypatch, sizes, lift):
    monkeypatch.setattr(co, "PART_PAIRS", sizes[0])
    monkeypatch.setattr(co, "CHUNK", sizes[1])
    rng = random.Random(6)
    data = [(u, [rng.choice([None, 99, *range(12)]) if rng.random() < 0.8 else 99 for _ in range(rng.randrange(12))]) for u in range(80)]
    data += data[:7] + [(5, [1, 2]), (5, [3, 2]), (None, [1, 2]), (200, None), (201, [])]
    df = spark.createDataFrame([(u, s, 0) for u, s in data], "u long, s array<long>, n int")
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_users"]) for r in pair_lift(df, "u", "s", 3, lift).collect()}
    assert got == brute(data, 3, lift)


def test_measures_and_empty(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [2]), (4, [3])], "u long, s array<long>")
    r = pair_lift(df, "u", "s", 1).first()
    assert (r["item_a"], r["item_b"], round(r["lift"], 6), r["conviction"]) == (1, 2, round(2 * 4 / 6, 6), None)
    assert pair_lift(df.limit(0), "u", "s", 1).collect() == []
    assert pair_lift(df.limit(0), "u", "s", 1, 2.0).collect() == []


def test_large_baskets_collapse_too(spark):
    """Baskets far over the size of a part, of users with one row and of users with several."""
    big = list(range(700))
    data = [(u, big) for u in range(6)] + [(u, big[k::2]) for u in range(10, 13) for k in (0, 1)] + [(20, [1, 2])]
    rows = pair_lift(spark.createDataFrame(data, "u long, s array<long>"), "u", "s", 9)
    got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in rows.collect()}
    assert len(got) == 700 * 699 // 2 and got[1, 2] == 10 and got[0, 699] == 9
    ui = spark.createDataFrame([(u, i) for u in (1, 2, 3) for i in (range(5) if u < 3 else range(4))], "u long, i long")
    assert sorted((r["u"], r["w"]) for r in co._collapsed_rows(ui).select("u", "w").distinct().collect()) == [(1, 2), (3, 1)]
