"""Vector expressions: norms, dot products, anchors, pooling. Vectors are arrays; sums run in array order in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.sequences import recent


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column, least: float | None = None) -> Column:
    """Unit length; a zero vector stays as it is, or is divided by ``least``."""
    n = norm(v)
    d = F.greatest(n, F.lit(least)) if least else F.when(n > 0, n).otherwise(F.lit(1.0))
    return F.transform(v.cast("array<double>"), lambda x: x / d)


def mean_of(rows: DataFrame, keys: list[str], vector: str, out: str = "v") -> DataFrame:
    """Element-wise mean per key; combined map-side by element."""
    per = rows.select(*keys, F.posexplode(vector).alias("_p", "_x")).groupBy(*keys, "_p").agg(F.avg("_x").alias("_m"))
    return per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_m"))).alias("_a")).select(*keys, F.col("_a._m").alias(out))


def anchors_single(users: DataFrame, user: str, item: str, vectors: DataFrame) -> DataFrame:
    """``user, anchor``: the normalised vector of one item. ``vectors``: ``item, e`` in unit length; users without one are left out (their anchor is the zero vector)."""
    v = vectors.select(F.col("item").alias(item), F.col("e").alias("_e"))
    return users.select(user, item).join(v, item).select(user, normalise(F.col("_e"), 1e-8).alias("anchor"))


def anchors_mean(users: DataFrame, user: str, history: str, vectors: DataFrame, last_n: int) -> DataFrame:
    """``user, anchor``: the normalised mean of the last ``last_n`` history items; repeats count, items without a vector count as zero."""
    steps = users.select(user, F.posexplode(recent(F.col(history), last_n)).alias("_p", "item"), F.least(F.size(history), F.lit(last_n)).alias("_n"))
    per = steps.join(vectors, "item").select(user, "_n", F.posexplode("e").alias("_d", "_x")).groupBy(user, "_n", "_d").agg((F.sum("_x") / F.col("_n")).alias("_m"))
    arr = per.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_a"))
    return arr.select(user, normalise(F.col("_a._m"), 1e-8).alias("anchor"))


def masked_mean_pool(tokens: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """``key, v``: sum of token vectors where the mask is 1, over max(number of such tokens, 1)."""
    w = F.col(mask).cast("double")
    per = tokens.select(key, w.alias("_w"), F.posexplode(vector).alias("_p", "_x")).groupBy(key, "_p").agg(F.sum(F.col("_x") * F.col("_w")).alias("_s"), F.sum("_w").alias("_n"))
    arr = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", (F.col("_s") / F.greatest("_n", F.lit(1.0))).alias("_m")))).alias("_a"))
    return arr.select(key, F.col("_a._m").alias("v"))
