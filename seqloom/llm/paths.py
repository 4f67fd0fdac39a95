"""Frequent subsequences with gaps: last-position induction.

An item extends a prefix exactly when its last position in the sequence lies beyond the position where the prefix first
ends. Sequences are reduced to their frequent items and identical ones collapse
into one with a weight; paths then grow level by level, each task counting its own sequences before
anything is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.baskets import user_items, user_rows, user_total
from seqloom.runtime import cut


#: Bits of the table that tells which paths of a level can be frequent; its size is the same for any number of paths.
TABLE_BITS = 1 << 22
#: Paths that a task counts before it hands them on.
FLUSH = 200_000
_MOD, _STEP = 2_147_483_647, 1_000_003


def path_hash(path: tuple, bits: int = TABLE_BITS) -> int:
    """Place of a path of item codes in a table of so many bits; ``_hash_column`` is the same for a column."""
    h = 0
    for x in path:
        h = (h * _STEP + x + 1) % _MOD
    return h % bits


def _hash_column(path: str):
    step = lambda h, x: F.pmod(h * F.lit(_STEP) + x + F.lit(1), F.lit(_MOD))
    return F.pmod(F.aggregate(path, F.lit(0).cast("bigint"), step), F.lit(TABLE_BITS))


class Levels:
    """Which paths can be frequent, by length: a bit table each. It may let a rare path pass, which is then counted and dropped, but never misses a frequent one."""

    def __init__(self, tables: dict[int, bytes] | None = None):
        self.tables = tables or {}

    @classmethod
    def of(cls, paths) -> Levels:
        out: dict[int, bytearray] = {}
        for p in paths:
            h = path_hash(p)
            out.setdefault(len(p), bytearray(TABLE_BITS // 8))[h >> 3] |= 1 << (h & 7)
        return cls({n: bytes(t) for n, t in out.items()})

    def holds(self, path: tuple) -> bool:
        t = self.tables.get(len(path))
        if t is None:
            return True
        h = path_hash(path, 8 * len(t))
        return bool(t[h >> 3] >> (h & 7) & 1)


def extend(seq: list[int], known: Levels, length: int) -> set[tuple]:
    """Paths of ``length`` different items in ``seq`` whose prefixes and suffixes of two items or more can be frequent."""
    last = {x: p for p, x in enumerate(seq)}
    out: set[tuple] = set()
    memo: dict[tuple, bool] = {}

    def ok(path: tuple) -> bool:
        got = memo.get(path)
        if got is None:
            got = memo[path] = known.holds(path)
        return got

    def grow(prefix: tuple, end: int) -> None:
        more = [x for x, p in last.items() if p > end and x not in prefix]  # the induction: last position beyond the prefix end
        if len(prefix) + 1 == length:
            out.update((*prefix, x) for x in more if length <= 2 or ok((*prefix[1:], x)))
            return
        for x in more:
            path = (*prefix, x)
            if len(path) < 2 or ok(path):
                grow(path, seq.index(x, end + 1))

    grow((), -1)
    return out


def frequent_paths(df: DataFrame, user: str, seq: str, min_share: float = 0.01, min_users: int = 5, lengths: tuple[int, int] = (3, 4)) -> DataFrame:
    """``path`` (array of item ids), ``n_users`` and ``support`` of each frequent path within ``lengths``.

    A path is an order of different items, other items in between allowed. Its support counts distinct users, and
    must reach ``min_share`` of all distinct non-null users (those without a sequence included) and
    ``min_users``. Null elements are skipped, repeated rows and a user's further rows never count a user twice,
    an empty table gives no rows.

    Bounds: at most (mean distinct items per user) / min_share items are frequent, and only these reach the tasks. Frequent paths of a
    level prune the next one through a bit table of ``TABLE_BITS`` bits, however many they are.
    """
    spark = df.sparkSession
    n = user_total(df, user).first()["n"] or 0
    least = max(min_users, -(-n * round(min_share * 1_000_000) // 1_000_000))
    single, several = user_rows(df, user, seq)
    items = user_items(single, several).groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    codes = np.array(sorted(r["i"] for r in items.select("i").collect()), dtype=np.int64)  # bounded, see above
    known = spark.sparkContext.broadcast(codes)

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("s")
            off = np.asarray(col.offsets, dtype=np.int64)
            flat = col.values
            ids = np.asarray(flat.fill_null(0) if flat.null_count else flat, dtype=np.int64)
            ok = ~np.asarray(flat.is_null()) if flat.null_count else np.ones(len(ids), bool)
            at = np.searchsorted(known.value, ids)
            at[at == len(known.value)] = 0
            ok &= known.value[at] == ids if len(known.value) else False
            row = np.zeros(len(ids) + 1, dtype=np.int64)
            owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
            span = slice(off[0], off[-1])
            kept, owner = at[span][ok[span]], owner[ok[span]]
            fresh = np.ones(len(kept), bool)  # a repeat right after itself changes no path of different items
            fresh[1:] = (kept[1:] != kept[:-1]) | (owner[1:] != owner[:-1])
            kept, owner = kept[fresh], owner[fresh]
            row = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(off) - 1))])
            lists = pa.ListArray.from_arrays(pa.array(row, pa.int32()), pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("u"), lists], names=["u", "c"])

    def codes_of(rows: DataFrame) -> DataFrame:
        kind = dict(rows.dtypes)["u"]
        return rows.mapInArrow(reduce_, f"u {kind}, c array<int>").filter(F.size("c") >= 2)

    # few and small partitions are left by the grouping: the search is spread over all cores
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    weighted = cut(codes_of(single).groupBy("c").agg(F.count(F.lit(1)).alias("w")).repartition(tasks, "c"))
    extra = cut(codes_of(several).distinct().repartition(tasks, "u", "c"))
    any_extra = not extra.isEmpty()

    def counted(length: int, known_: Levels) -> DataFrame:
        g = spark.sparkContext.broadcast(known_)

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c: dict[tuple, int] = defaultdict(int)
            for b in batches:
                for s, w in zip(b.column("c").to_pylist(), b.column("w").to_pylist()):
                    if len(s) >= length:
                        for p in extend(s, g.value, length):
                            c[p] += w
                        if len(c) > FLUSH:
                            yield out(c)
                            c.clear()
            yield out(c)

        def out(c: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(p) for p in c], pa.list_(pa.int32())), pa.array(list(c.values()), pa.int64())], names=["p", "w"])

        def by_user(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                us, ps = [], []

                def rows() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([b.column("u").take(pa.array(us, pa.int64())), pa.array(ps, pa.list_(pa.int32()))], names=["u", "p"])

                for k, s in enumerate(b.column("c").to_pylist()):
                    found = extend(s, g.value, length)
                    us += [k] * len(found)
                    ps += [list(p) for p in found]
                    if len(ps) > FLUSH:
                        yield rows()
                        us, ps = [], []
                yield rows()

        all_ = weighted.mapInArrow(local, "p array<int>, w bigint")
        if any_extra:
            more = extra.mapInArrow(by_user, f"u {dict(extra.dtypes)['u']}, p array<int>").distinct().select("p", F.lit(1).cast("bigint").alias("w"))
            all_ = all_.unionByName(more)
        return all_.groupBy("p").agg(F.sum("w").alias("n_users")).filter(F.col("n_users") >= least)

    found, levels = [], Levels()
    for length in range(2, lengths[1] + 1):
        level = cut(counted(length, levels))
        if length >= lengths[0]:
            found.append(level)
        if length < lengths[1]:
            at = level.select(_hash_column("p").cast("int").alias("h")).distinct().toPandas()["h"].to_numpy(np.int64)  # TABLE_BITS rows at most
            bits = np.zeros(TABLE_BITS, np.uint8)
            bits[at] = 1
            levels = Levels({**levels.tables, length: np.packbits(bits, bitorder="little").tobytes()})
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    to_id = F.transform("p", lambda x: F.element_at(F.lit(codes.tolist()).cast("array<bigint>"), x + 1)) if len(codes) else F.lit(None).cast("array<bigint>")
    return out.select(to_id.alias("path"), "n_users", F.round(F.col("n_users") / F.lit(max(n, 1)), 6).alias("support"))
