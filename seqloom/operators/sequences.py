"""Sequences of users: built from logs, reduced, split and taken apart again.

A sequence is an array column; every operator on one is a built-in expression, so chains of them stay in one stage. Null sequences stay null in all
column functions, null elements are ordinary values unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordering import first_per_key, numbered, top_per_key

MIN_LENGTH = 3


def build_sequences(log: DataFrame, user: str, item: str, order: Sequence[str], seq: str = "seq") -> DataFrame:
    """``user, seq``: a user's items in the order of ``order`` (make it total, or ties fall by item). One row a user, null users are a user too."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item"))))
    return log.groupBy(user).agg(rows.alias("_s")).select(user, F.col("_s._item").alias(seq))


def build_recent(log: DataFrame, user: str, item: str, order: Sequence[str], n: int, seq: str = "seq") -> DataFrame:
    """As ``build_sequences``, but only the ``n`` most recent items: each task passes on n rows a user at most, whatever a user holds."""
    late = top_per_key(log, [user], [F.desc(c) for c in [*order, item]], n, "_r").drop("_r")
    return build_sequences(late, user, item, order, seq)


def positions(df: DataFrame, user: str, seq: str, item: str = "item_id", pos: str = "pos") -> DataFrame:
    """Long form ``user, pos, item``; positions count from 1. Null and empty sequences give no row."""
    return df.select(user, F.posexplode(seq).alias("_p", item)).select(user, (F.col("_p") + 1).cast("bigint").alias(pos), item)


def dedup_consecutive(seq: Column) -> Column:
    """Immediate repeats collapse; a later return stays: [a, a, b, a] -> [a, b, a]."""
    return F.filter(seq, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(seq, i - 1)))


def distinct_first(seq: Column) -> Column:
    """Each item at its first place only."""
    return F.array_distinct(seq)


def recent(seq: Column, n: int) -> Column:
    """The last ``n`` elements; shorter sequences stay whole."""
    return F.slice(seq, F.greatest(F.size(seq) - n + 1, F.lit(1)), n)


def append_next(prev: Column, nxt: Column) -> Column:
    """``prev`` followed by the next item; null if either is null."""
    return F.concat(prev, F.array(nxt))


def all_but(seq: Column, k: int) -> Column:
    """Without the last ``k`` elements: 2 gives the training slice, 1 the evaluation slice, 0 the whole."""
    return F.slice(seq, 1, F.greatest(F.size(seq) - k, F.lit(0)))


def targets(df: DataFrame, user: str, seq: str) -> DataFrame:
    """``user, target, last, before_last, history``: the held-out item, the last two items before it (null if missing) and everything before it."""
    s = F.col(seq)
    h = all_but(s, 1)
    return df.filter(F.size(seq) >= 1).select(
        user, F.get(s, F.size(s) - 1).alias("target"), F.get(s, F.size(s) - 2).alias("last"), F.when(F.size(s) >= 3, F.get(s, F.size(s) - 3)).alias("before_last"), h.alias("history")
    )


def long_enough(df: DataFrame, seq: str, n: int = MIN_LENGTH) -> DataFrame:
    return df.filter(F.size(seq) >= n)


def bigrams(df: DataFrame, seq: str) -> DataFrame:
    """``src, dst`` for each pair of neighbours, repeats included."""
    s = F.col(seq)
    n = F.greatest(F.size(s) - 1, F.lit(0))
    return df.select(F.explode(F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("p")).select("p.src", "p.dst")


# -- pairs of user and item ------------------------------------------------------------------------------


def pair_first_row(log: DataFrame, user: str, item: str, order: Sequence[str]) -> DataFrame:
    """The first row of each (user, item)."""
    return first_per_key(log, [user, item], list(order))


def pair_min_ts(log: DataFrame, user: str, item: str, ts: str, order: str) -> DataFrame:
    """``user, item, ts, first``: the least time of each pair and the pair's first place in ``order``; null times are passed over."""
    return log.groupBy(user, item).agg(F.min(ts).alias(ts), F.min(order).alias("first"))


# -- dense ids -------------------------------------------------------------------------------------------


def dense_ids(keys: DataFrame, key: str, name: str) -> DataFrame:
    """``key, name``: ids 0, 1, ... of the distinct non-null keys in ascending order."""
    return numbered(keys.select(key).filter(F.col(key).isNotNull()).distinct(), [key], name)


def first_seen_ids(seqs: DataFrame, user: str, seq: str, item: str = "item_id", name: str = "dense_id") -> DataFrame:
    """Ids of items by first appearance, walking users in ascending order."""
    seen = positions(seqs, user, seq, item).groupBy(item).agg(F.min(F.struct(user, "pos")).alias("_f"))
    return numbered(seen, [F.col("_f")], name).select(item, name)


# -- latest history and clicks ---------------------------------------------------------------------------


def history_plus_clicks(histories: DataFrame, clicks: DataFrame, user: str, seq: str = "seq") -> DataFrame:
    """``user, seq``: the latest history followed by the clicks in their order, each item at its first place.

    ``histories``: ``user, ts, ord, items`` (the first row wins a tie in ts); ``clicks``: ``user, ts, ord, item``. A user in only one
    of them is kept.
    """
    late = F.coalesce(-F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1 << 62))
    h = histories.groupBy(user).agg(F.min_by("items", F.struct(late, "ord")).alias("_h"))
    c = build_sequences(clicks, user, "item", ["ts", "ord"], "_c")
    empty = F.array().cast(dict(h.dtypes)["_h"])
    both = h.join(c, user, "full")
    return both.select(user, F.array_distinct(F.concat(F.coalesce("_h", empty), F.coalesce("_c", empty))).alias(seq))
