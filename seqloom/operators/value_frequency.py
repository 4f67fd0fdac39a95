"""Per-key statistics without imbalance: value-frequency compression.

Rows are first grouped by key *and* value, which spreads a hot key over its values and lets
every task combine its own repeats before the shuffle. What reaches the grouping by key alone
is one weighted row per distinct value; totals, distinct counts and modes are combined map-side
again, and exact percentiles come from a prefix sum over range partitions, so that no task ever
holds all values of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.runtime import cut


def compress(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """``(k, v, w)``: each distinct value of each key with its number of rows. Null keys are kept as a key of their own."""
    return df.select(key.alias("k"), value.alias("v")).groupBy("k", "v").agg(F.count(F.lit(1)).alias("w"))


def key_totals(pairs: DataFrame) -> DataFrame:
    """Exact totals per key from weighted pairs.

    Columns: ``k``, ``n_rows`` (all rows), ``n_values`` (rows with a value), ``n_distinct``,
    ``value_sum`` (for numeric values; null if the key has none) and ``mode`` (most frequent value, the
    smaller at a tie; null if the key has no value). Null values count in ``n_rows`` only.
    """
    has = F.col("v").isNotNull()
    heavy = F.max(F.when(has, F.struct(F.col("w"), (-F.col("v")).alias("nv"))))
    return pairs.groupBy("k").agg(
        F.sum("w").alias("n_rows"),
        F.coalesce(F.sum(F.when(has, F.col("w"))), F.lit(0)).alias("n_values"),
        F.count("v").alias("n_distinct"),
        F.sum(F.col("v") * F.col("w")).alias("value_sum"),
        (-heavy["nv"]).alias("mode"),
    )


def key_percentiles(pairs: DataFrame, qs: Sequence[float], partitions: int | None = None) -> DataFrame:
    """Exact lower percentiles per key: the smallest value whose cumulated weight reaches ``ceil(q * n)``.

    Columns ``k`` and ``p<q*100>`` per q. Keys without values don't appear. The pairs are range partitioned by (key,
    value): a hot key covers many partitions. Running sums are taken within (key, partition) and
    shifted by the total of the partitions before, of which a key has at most ``partitions``.
    """
    spark = pairs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Read twice below, so the partition numbers must be fixed once.
    ranged = cut(pairs.filter(F.col("v").isNotNull()).repartitionByRange(n, "k", "v").withColumn("pid", F.spark_partition_id()))
    part = ranged.groupBy("k", "pid").agg(F.sum("w").alias("pw"))
    before = Window.partitionBy("k").orderBy("pid")
    part = part.select(
        F.col("k").alias("pk"),
        F.col("pid").alias("ppid"),
        (F.sum("pw").over(before) - F.col("pw")).alias("shift"),
        F.sum("pw").over(Window.partitionBy("k")).alias("n"),
    )
    inside = Window.partitionBy("k", "pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = (
        ranged.withColumn("run", F.sum("w").over(inside))
        .join(part, [F.col("k").eqNullSafe(F.col("pk")), F.col("pid") == F.col("ppid")])
        .select("k", "v", (F.col("run") + F.col("shift")).alias("cum"), "n")
    )
    return run.groupBy("k").agg(
        *[F.min(F.when(F.col("cum") >= F.ceil(F.lit(q) * F.col("n")), F.col("v"))).alias(f"p{round(q * 100)}") for q in qs]
    )


def value_frequency(df: DataFrame, key: Column, value: Column, qs: Sequence[float] = ()) -> DataFrame:
    """Totals (see ``key_totals``) and, if asked for, percentiles of ``value`` per ``key``.

    Null keys form a group of their own, an empty input gives no rows, and only the two named
    expressions are read, so further columns can have any name.
    """
    pairs = compress(df, key, value)
    totals = key_totals(pairs)
    if not qs:
        return totals
    pairs = cut(pairs)
    totals = key_totals(pairs)
    pct = key_percentiles(pairs, qs).withColumnRenamed("k", "pk")
    return totals.join(pct, F.col("k").eqNullSafe(F.col("pk")), "left").drop("pk")
