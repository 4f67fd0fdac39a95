import random
from collections import Counter

from pyspark.sql import functions as F

from seqloom.operators.value_frequency import compress, key_percentiles, value_frequency


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(1)
    data = [(7 if rng.random() < 0.4 else rng.randrange(20), rng.choice([None, *range(50)]), "x") for _ in range(3000)]
    df = spark.createDataFrame(data, "k long, v long, w string")  # the extra column clashes with an internal name
    got = {r["k"]: r for r in value_frequency(df, F.col("k"), F.col("v"), (0.5, 0.9)).collect()}
    for k in {d[0] for d in data}:
        values = sorted(d[1] for d in data if d[0] == k and d[1] is not None)
        r = got[k]
        assert r["n_rows"] == sum(d[0] == k for d in data)
        assert (r["n_values"], r["n_distinct"], r["value_sum"]) == (len(values), len(set(values)), sum(values))
        top = max(Counter(values).items(), key=lambda x: (x[1], -x[0]))[0]
        assert r["mode"] == top
        for q in (0.5, 0.9):
            need = -(-len(values) * round(q * 100) // 100)
            assert r[f"p{round(q * 100)}"] == values[need - 1]


def test_one_key_over_many_partitions(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id")
    r = key_percentiles(compress(df, F.col("k"), F.col("id")), [0.1, 0.5], partitions=16).collect()
    assert [tuple(x) for x in r] == [(1, 99, 499)]


def test_nulls_and_empty(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, None), (2, None)], "k long, v long")
    got = {r["k"]: (r["n_rows"], r["n_values"], r["mode"], r["p50"]) for r in value_frequency(df, F.col("k"), F.col("v"), [0.5]).collect()}
    assert got == {None: (2, 1, 1, 1), 2: (1, 0, None, None)}
    assert rows(value_frequency(df.limit(0), F.col("k"), F.col("v"), [0.5])) == []
