"""Items that appear together: basket collapsing.

Each user's items become one sorted, deduplicated basket; identical baskets collapse into one with a weight,
and pairs are enumerated once per distinct basket and summed by weight. A basket with many pairs is enumerated in as many parts as
these ask for, so that no task expands a huge basket alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.baskets import user_items, user_rows, user_total
from seqloom.runtime import cut

#: Pairs of one part of a basket, and items of a chunk of a user's rows.
PART_PAIRS, CHUNK = 131_072, 256


def _pairs_of_arrays(baskets: DataFrame, tasks: int) -> DataFrame:
    """``a, b, w`` of distinct sorted baskets ``(b, w)`` of any size."""
    n = F.size("b").cast("bigint")
    parts = F.ceil(n * (n - 1) / F.lit(2 * PART_PAIRS)).cast("int")
    spread = baskets.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # baskets of like size would else lie together, as the grouping left them
    spread = spread.repartition(tasks, F.xxhash64("b"), "part")
    first = spread.select("w", "parts", "part", F.col("b").alias("_b"), F.posexplode("b").alias("_p", "a")).filter(F.pmod("_p", F.col("parts")) == F.col("part"))
    rest = F.slice("_b", F.col("_p") + 2, F.greatest(F.size("_b") - F.col("_p") - 1, F.lit(0)))
    return first.select("w", "a", F.explode(rest).alias("b"))


def _collapsed_rows(items: DataFrame) -> DataFrame:
    """``u, i, n, w``: of users with the same set of items (``u, i`` distinct) one stays, with the number of them.

    Sets are told apart by their size and two sums of independent hashes, which are combined map-side, so no set is gathered.
    """
    h = F.xxhash64("i")
    sign = items.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64("i", F.lit(1)).cast("decimal(38,0)")).alias("h2"))
    kept = sign.groupBy("n", "h1", "h2").agg(F.min("u").alias("u"), F.count(F.lit(1)).alias("w")).select("u", "n", "w")
    return items.join(kept, "u")


def _pairs_of_rows(rows: DataFrame) -> DataFrame:
    """``a, b, w`` of ``(u, i, n, w)`` rows, one row per pair of chunks of a user's items, whatever their number."""
    chunks = rows.withColumn("c", F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / F.lit(CHUNK))).cast("int")).groupBy("u", "n", "w", "c").agg(F.collect_list("i").alias("b"))
    chunks = chunks.withColumn("parts", F.ceil(F.col("n") / F.lit(16 * CHUNK)).cast("int"))
    left = chunks.select("u", "w", F.col("c").alias("c1"), F.col("b").alias("b1"), F.floor(F.col("c") / 16).cast("int").alias("part"))
    right = chunks.select("u", F.col("c").alias("c2"), F.col("b").alias("b2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = left.join(right, ["u", "part"]).filter("c1 <= c2").select("w", "c1", "c2", F.explode("b1").alias("x"), "b2")
    flat = both.select("w", "c1", "c2", "x", F.explode("b2").alias("y")).filter("(c1 < c2 AND x <> y) OR (c1 = c2 AND x < y)")
    return flat.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w")


def pair_lift(df: DataFrame, user: str, seq: str, min_users: int = 6, min_lift: float | None = None) -> DataFrame:
    """Pairs ``item_a < item_b`` that at least ``min_users`` users hold, with how far this exceeds chance.

    Columns: ``n_ab, n_a, n_b, n_users`` (distinct non-null users, each counted once, users without
    items included), ``lift`` = n_ab * n_users / (n_a * n_b) and ``conviction`` of a -> b, null if
    every user with a has b. Null elements, null users, null and empty sequences add no items;
    repeats within a sequence and repeated rows count once; an empty table gives no rows.

    With ``min_lift``, items on more than 1/min_lift of all users are left out before pairs are formed: as
    n_ab <= min(n_a, n_b), their lift is at most n_users / max(n_a, n_b) < min_lift, so no pair is lost. At most
    min_lift * (mean basket size) items are that frequent, which bounds the broadcast set.
    """
    spark = df.sparkSession
    single, several = user_rows(df, user, seq)
    total = user_total(df, user).first()["n"] or 0
    items = cut(user_items(single, several).groupBy("i").agg(F.count(F.lit(1)).alias("n")))
    several_ui = several.select("u", F.explode("s").alias("i")).filter(F.col("i").isNotNull()).distinct()
    baskets = single.select(F.array_sort(F.array_compact(F.array_distinct("s"))).alias("b"))
    if min_lift:
        often = [r["i"] for r in items.filter(F.col("n") * F.lit(min_lift) > F.lit(total)).select("i").collect()]  # bounded, see above
        if often:
            kind = dict(items.dtypes)["i"]
            baskets = baskets.withColumn("b", F.array_except("b", F.lit(often).cast(f"array<{kind}>")))
            several_ui = several_ui.join(F.broadcast(spark.createDataFrame([(i,) for i in often], f"i {kind}")), "i", "left_anti")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    collapsed = baskets.filter(F.size("b") >= 2).groupBy("b").agg(F.count(F.lit(1)).alias("w"))
    pairs = _pairs_of_arrays(collapsed, tasks)
    if not several.isEmpty():
        pairs = pairs.unionByName(_pairs_of_rows(_collapsed_rows(cut(several_ui))))
    pairs = pairs.groupBy("a", "b").agg(F.sum("w").alias("n_ab")).filter(F.col("n_ab") >= min_users)
    na = items.select(F.col("i").alias("a"), F.col("n").alias("n_a"))
    nb = items.select(F.col("i").alias("b"), F.col("n").alias("n_b"))
    n = F.col("n_users")
    conf = F.col("n_ab") / F.col("n_a")
    out = (
        pairs.join(na, "a")
        .join(nb, "b")
        .withColumn("n_users", F.lit(total).cast("bigint"))
        .select(
            F.col("a").alias("item_a"),
            F.col("b").alias("item_b"),
            "n_ab",
            "n_a",
            "n_b",
            "n_users",
            (F.col("n_ab") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"),
            F.when(conf < 1, (1 - F.col("n_b") / n) / (1 - conf)).alias("conviction"),
        )
    )
    return out.filter(F.col("n_ab") * n >= F.lit(min_lift) * F.col("n_a") * F.col("n_b")) if min_lift else out
