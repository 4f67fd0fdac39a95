"""Users' sequences as input of the pair and path operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.runtime import cut


def user_rows(df: DataFrame, user: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """Distinct rows of a user table, as ``(single, several)``.

    ``single``: ``u, s`` of users with one distinct non-empty row. ``several``: ``u, s`` of users with more
    than one, which need a distinct count by user. Null users, null and empty sequences are left out.
    The grouping keeps a count and one row per user, so a user with very many rows stays cheap.
    """
    rows = df.select(F.col(user).alias("u"), F.col(seq).alias("s")).filter(F.col("u").isNotNull() & (F.size("s") > 0)).distinct()
    per = cut(rows.groupBy("u").agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("s")))  # read many times
    single = per.filter("c = 1").select("u", "s")
    several = cut(rows.join(per.filter("c > 1").select("u"), "u", "left_semi"))
    return single, several


def user_total(df: DataFrame, user: str) -> DataFrame:
    """One row: the number of distinct non-null users, those without a sequence included."""
    return df.agg(F.countDistinct(user).alias("n"))


def user_items(single: DataFrame, several: DataFrame) -> DataFrame:
    """Distinct ``u, i``; for users with one row this needs no shuffle."""
    one = single.select("u", F.explode(F.array_distinct("s")).alias("i"))
    more = several.select("u", F.explode("s").alias("i")).distinct()
    return one.unionByName(more).filter(F.col("i").isNotNull())
