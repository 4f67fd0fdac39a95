"""Frequency filters: k-cores in four variants, item thresholds, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordering import top_per_key
from seqloom.operators.sequences import dedup_consecutive
from seqloom.runtime import cut


def _often(log: DataFrame, key: str, least: int, distinct: str | None = None) -> DataFrame:
    """Keys with enough rows, or enough distinct values of another column."""
    rows = log.select(key, distinct).distinct() if distinct else log
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(key)


def kcore_one_pass(seqs: DataFrame, user: str, seq: str, k: int = 5, min_len: int = 3, collapse: bool = True) -> DataFrame:
    """Drops items with under ``k`` occurrences, collapses repeats that this leaves, keeps users with at least max(k, min_len) items. Not repeated."""
    occ = seqs.select(user, F.posexplode(seq).alias("_p", "_i"))
    keep = _often(occ, "_i", k)
    kept = occ.join(keep, "_i", "left_semi").groupBy(user).agg(F.array_sort(F.collect_list(F.struct("_p", "_i"))).alias("_s")).select(user, F.col("_s._i").alias(seq))
    if collapse:
        kept = kept.withColumn(seq, dedup_consecutive(F.col(seq)))
    return kept.filter(F.size(seq) >= max(k, min_len))


def bipartite_kcore(pairs: DataFrame, user: str, item: str, min_users: int, min_items: int, iterative: bool = False) -> DataFrame:
    """Drops items with few distinct users, then users with few distinct items; once, or until nothing changes.

    No-op if both thresholds are at most 1. Each round is written to the shared folder, so lineage doesn't grow.
    """
    if min_users <= 1 and min_items <= 1:
        return pairs

    def once(rows: DataFrame) -> DataFrame:
        rows = rows.join(_often(rows, item, min_users, user), item, "left_semi")
        return rows.join(_often(rows, user, min_items, item), user, "left_semi")

    if not iterative:
        return once(pairs).select(*pairs.columns)
    # The core depends on the distinct pairs alone, which are narrow; the log itself is read at the end.
    now = cut(pairs.filter(F.col(user).isNotNull() & F.col(item).isNotNull()).select(user, item).distinct())
    n = now.count()
    while n:
        now = cut(_distinct_once(_distinct_once(now, user, item, min_users, min_items), user, item, min_users, min_items))
        m, n = n, now.count()
        if m == n:
            break
    return pairs.join(now, [user, item], "left_semi").select(*pairs.columns)


def _distinct_once(pairs: DataFrame, user: str, item: str, min_users: int, min_items: int) -> DataFrame:
    """One round on distinct pairs, whose rows can be counted as they are."""
    pairs = pairs.join(_often(pairs, item, min_users), item, "left_semi")
    return pairs.join(_often(pairs, user, min_items), user, "left_semi")


def original_counts_kcore(log: DataFrame, user: str, item: str, min_user: int = 5, min_item: int = 5) -> DataFrame:
    """Both counts come from the log as it is, and both filters apply at once."""
    return log.join(_often(log, user, min_user), user, "left_semi").join(_often(log, item, min_item), item, "left_semi").select(*log.columns)


def item_threshold(log: DataFrame, item: str, least: int = 5) -> DataFrame:
    return log.join(_often(log, item, least), item, "left_semi").select(*log.columns)


def valid_tags(triples: DataFrame, names: DataFrame, user: str, tag: str, name: str, min_users: int = 5, max_len: int = 40) -> DataFrame:
    """``tag, name`` of tags with enough distinct users and a stripped name that is not empty, not too long and has a letter."""
    clean = F.regexp_replace(F.col(name), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    ok = names.select(tag, clean.alias(name)).filter((F.length(name) > 0) & (F.length(name) <= max_len) & F.col(name).rlike(r"\p{L}"))
    return ok.join(_often(triples, tag, min_users, user), tag, "left_semi")


def top_tags(triples: DataFrame, valid: DataFrame, item: str, tag: str, name: str, k: int = 5, min_count: int = 1) -> DataFrame:
    """``item, rank, name``: an item's ``k`` most frequent valid tags, ties by tag as a string."""
    counts = triples.groupBy(item, tag).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_count).join(valid, tag)
    return top_per_key(counts, [item], [F.desc("_n"), F.col(tag).cast("string")], k).select(item, "rank", name)
