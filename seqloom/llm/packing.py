"""Filling fixed-capacity containers: sum-of-squares online packing.

A container's fill level is all that matters for the next document. With N(h) open containers at level h, a
document goes to the level that leaves the sum of N(h)^2 smallest, a fresh container
being level 0; the counts live in one array by level.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.runtime import cut

CAPACITY = 2048
#: Containers' worth of tokens, and documents with tokens, in a shard. More make fuller containers, fewer spread over more tasks.
SHARD_CONTAINERS, SHARD_ROWS = 4096, 262_144


class SumOfSquares:
    """Places sizes of 1 to ``capacity`` one after another; ``place`` returns the number of the container."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1)
        self.count[capacity] = -0.5  # a full container leaves the sum: the change below becomes right without a special case
        self.open: list[list[int]] = [[] for _ in range(capacity)]
        self.used = 0

    def place(self, size: int) -> int:
        c, n = self.capacity, self.count
        best, level = (2 * n[size] + 1 if size < c else 0.0), 0
        if size < c:
            here = n[1 : c - size + 1]
            change = np.where(here > 0, 2 * (n[size + 1 : c + 1] - here) + 2, np.inf)
            k = int(len(change) - 1 - np.argmin(change[::-1]))  # the fuller level at a tie
            if change[k] <= best:
                level = k + 1
        if level:
            box = self.open[level].pop()
            n[level] -= 1
        else:
            box = self.used
            self.used += 1
        if level + size < c:
            self.open[level + size].append(box)
            n[level + size] += 1
        return box


def pack_shard(keys: np.ndarray, sizes: np.ndarray, capacity: int) -> list[tuple]:
    """``(key, part, size, container)`` of one shard, placed one after another in the order given. Sizes over the capacity are cut into full parts and a rest; size 0 goes to container 0."""
    sos, out = SumOfSquares(capacity), []
    for key, size in zip(keys, sizes):
        size, part = int(size), 0
        while size > capacity:
            out.append((key, part, capacity, sos.place(capacity)))
            size -= capacity
            part += 1
        out.append((key, part, size, sos.place(size) if size else 0))
    return out


def pack(
    sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, shard_containers: int = SHARD_CONTAINERS, shard_rows: int = SHARD_ROWS, order: Sequence[Column | str] | None = None
) -> DataFrame:
    """``key, part, n_tokens, container`` of each part of each document.

    Containers hold at most ``capacity`` tokens; only documents over it have more than one part. Documents are
    spread over shards by a hash of their id, each with about ``shard_containers`` containers and at most about ``shard_rows`` documents, and
    within their shard they are placed online, one after another: in the order of ``order``, by default as they arrive, by id.
    The loss at the end of a shard is a few containers. Null sizes count as 0, and a document of size 0 takes no room: it is
    given its shard's first container without passing through the packing. An empty table gives no rows. The number of shards
    follows from the tokens and documents of the whole table and from nothing else.
    """
    rows = cut(sizes.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"), F.struct(*(order or [key])).alias("o")))
    total, many = rows.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, -(-total // (capacity * shard_containers)), -(-many // shard_rows))
    kind = dict(rows.dtypes)["k"]
    mixed = rows.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", kind="stable")
        out = pd.DataFrame(pack_shard(pdf["k"].to_numpy(), pdf["n"].to_numpy(), capacity), columns=["k", "part", "n", "c"])
        out["c"] += int(pdf["shard"].iloc[0]) << 32
        return out

    # the order may be of any kind, so Spark sorts; a shard's rows are bounded
    placed = mixed.filter("n > 0").withColumn("p", F.row_number().over(Window.partitionBy("shard").orderBy("o", F.xxhash64("k"))))
    packed = placed.select("k", "n", "shard", "p").groupBy("shard").applyInPandas(run, f"k {kind}, part int, n bigint, c bigint")
    empty = mixed.filter("n = 0").select("k", F.lit(0).alias("part"), "n", F.shiftleft("shard", 32).alias("c"))
    return packed.unionByName(empty).select(F.col("k").alias(key), "part", F.col("n").alias(size), F.col("c").alias("container"))
