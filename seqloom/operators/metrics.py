"""Ranking metrics, dataset statistics and their verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_metrics(rows: DataFrame, items: str, target: str, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """``k, n_users, recall, ndcg``: mean hit, and mean 1 / log2(rank + 1) of the target's first place; 0 if it is not within k. No users give 0."""
    at = F.array_position(items, F.col(target))
    one = rows.select(F.coalesce(at, F.lit(0)).alias("r"))
    flat = one.select("r", F.explode(F.lit(list(ks))).alias("k"))
    hit = (F.col("r") > 0) & (F.col("r") <= F.col("k"))
    return flat.groupBy("k").agg(F.count(F.lit(1)).alias("n_users"), F.avg(hit.cast("double")).alias("recall"), F.avg(F.when(hit, 1 / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("ndcg"))


def dataset_stats(seqs: DataFrame, seq: str, items: DataFrame) -> DataFrame:
    """One row: ``n_users, n_items, n_interactions, avg_len``; items are counted in the catalogue."""
    base = seqs.agg(F.count(F.lit(1)).alias("n_users"), F.coalesce(F.sum(F.size(seq)), F.lit(0)).alias("n_interactions"))
    return base.withColumn("n_items", items.agg(F.count(F.lit(1))).scalar()).select(
        "n_users", "n_items", "n_interactions", F.when(F.col("n_users") > 0, F.col("n_interactions") / F.col("n_users")).otherwise(0.0).alias("avg_len")
    )


def verify(stats: DataFrame, expected: dict[str, float], tolerance: float = 0.01) -> DataFrame:
    """``name, expected, found, status``: OK or MISMATCH for each expected figure; the average length may differ by ``tolerance``."""
    rows = [F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("expected"), F.col(n).cast("double").alias("found")) for n, v in expected.items()]
    flat = stats.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    gap = F.abs(F.col("found") - F.col("expected"))
    return flat.withColumn("status", F.when(gap <= F.when(F.col("name") == "avg_len", F.lit(tolerance)).otherwise(0.0), "OK").otherwise("MISMATCH"))
