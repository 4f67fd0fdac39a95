"""Numbering rows in a total order without gathering them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.runtime import cut


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0, partitions: int | None = None) -> DataFrame:
    """``df`` with each row's place (from ``start``) in the order of ``order``.

    Rows are range partitioned and sorted within their partition; a row's place is its index there plus the rows of all partitions before,
    of which the driver holds one number each. Rows that are equal under ``order`` are numbered in any order.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shift, at = [], start
    for p in range(max(counts, default=0) + 1):
        shift.append(at)
        at += counts.get(p, 0)
    offset = F.element_at(F.lit(shift).cast("array<bigint>"), (part + 1).cast("int"))
    return placed.withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + offset).drop("_at")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a total order; each task keeps one row a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank from 1. The limit is applied in each task before the shuffle, so a hot key sends k rows a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
