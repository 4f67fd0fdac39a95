from pyspark.sql import functions as F

from seqloom.operators import sequences as sq
from seqloom.operators.ordering import numbered


def _seq(spark, *lists):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "user_id long, seq array<long>")


def _lists(df):
    return [r["seq"] for r in df.orderBy("user_id").collect()]


def test_build_orders_ties_and_keeps_repeats(spark):
    log = spark.createDataFrame([(1, 5, 2, 0), (1, 3, 1, 9), (1, 4, 2, 0), (2, 7, 1, 1)], "u long, i long, ts long, ord long")
    got = {r["u"]: r["seq"] for r in sq.build_sequences(log, "u", "i", ["ts", "ord"]).collect()}
    assert got == {1: [3, 4, 5], 2: [7]}
    assert {r["u"]: r["seq"] for r in sq.build_recent(log, "u", "i", ["ts", "ord"], 2).collect()} == {1: [4, 5], 2: [7]}


def test_array_operators(spark):
    df = _seq(spark, [1, 1, 2, 1], [None, None, 3], [], None)
    assert _lists(df.withColumn("seq", sq.dedup_consecutive(F.col("seq")))) == [[1, 2, 1], [None, 3], [], None]
    assert _lists(df.withColumn("seq", sq.distinct_first(F.col("seq")))) == [[1, 2], [None, 3], [], None]
    assert _lists(_seq(spark, [1, 2, 3], list(range(9))).withColumn("seq", sq.recent(F.col("seq"), 5))) == [[1, 2, 3], [4, 5, 6, 7, 8]]
    for k, want in ((2, [1]), (1, [1, 2]), (0, [1, 2, 3])):
        assert _lists(_seq(spark, [1, 2, 3]).withColumn("seq", sq.all_but(F.col("seq"), k))) == [want]
    assert _lists(_seq(spark, [1]).withColumn("seq", sq.append_next(F.col("seq"), F.lit(9)))) == [[1, 9]]


def test_targets(spark):
    t = sq.targets(_seq(spark, [1, 2, 3], [5, 6], [7], []), "user_id", "seq").orderBy("user_id").collect()
    assert [(r["target"], r["last"], r["before_last"], r["history"]) for r in t] == [(3, 2, 1, [1, 2]), (6, 5, None, [5]), (7, None, None, [])]


def test_bigrams(spark, rows):
    assert rows(sq.bigrams(_seq(spark, [1, 2, 2, 1], [5], []), "seq")) == [(1, 2), (2, 1), (2, 2)]


def test_pairs(spark, rows):
    log = spark.createDataFrame([(1, 1, 9, 0), (1, 1, 3, 1), (1, 2, None, 2)], "u long, i long, ts long, ord long")
    assert rows(sq.pair_first_row(log, "u", "i", ["ord"]).select("u", "i", "ts")) == [(1, 1, 9), (1, 2, None)]
    assert rows(sq.pair_min_ts(log, "u", "i", "ts", "ord")) == [(1, 1, 3, 0), (1, 2, None, 2)]


def test_ids(spark, rows):
    keys = spark.createDataFrame([("2",), ("10",), (None,), ("2",)], "k string")
    assert rows(sq.dense_ids(keys, "k", "id")) == [("10", 0), ("2", 1)]
    assert rows(sq.first_seen_ids(_seq(spark, [5, 3], [4, 3]), "user_id", "seq")) == [(3, 1), (4, 2), (5, 0)]
    got = numbered(spark.range(1000).select((F.lit(999) - F.col("id")).alias("x")), ["x"], "n", partitions=7)
    assert got.filter("x <> n").count() == 0 and got.count() == 1000


def test_history_plus_clicks(spark):
    h = spark.createDataFrame([(1, 5, 0, [1, 2]), (1, 5, 1, [9]), (1, 4, 2, [8]), (3, 1, 3, [4, 4])], "u long, ts long, ord long, items array<long>")
    c = spark.createDataFrame([(1, 2, 1, 2), (1, 1, 0, 7), (2, 1, 0, 6)], "u long, ts long, ord long, item long")
    assert {r["u"]: r["seq"] for r in sq.history_plus_clicks(h, c, "u").collect()} == {1: [1, 2, 7], 2: [6], 3: [4]}
