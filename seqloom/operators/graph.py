"""The transition graph and hop rings on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.sequences import all_but, bigrams
from seqloom.runtime import cut


#: Successors of a vertex that one part of a step holds.
HUB = 4096


def transitions(seqs: DataFrame, seq: str, held_out: int = 2) -> DataFrame:
    """``src, dst, cnt``: how often dst directly follows src in the training slices; self-loops are kept. Counts are combined map-side."""
    return bigrams(seqs.select(all_but(F.col(seq), held_out).alias("_t")), "_t").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt"))


def from_shards(rows: DataFrame, src: str, dst: str, count: str) -> DataFrame:
    """``src, dst, cnt`` from counts per shard: exact copies count once, null counts and null ends are left out."""
    return rows.distinct().filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & F.col(count).isNotNull()).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.sum(count).alias("cnt"))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    """``item``: every end of an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("item")).distinct()


def edge_weights(edges: DataFrame) -> DataFrame:
    """``src, dst, w`` = ln(1 + cnt) over the largest such value of the source (0 counts as 1).

    The maximum comes from a map-side aggregate and a join, so a source with very many edges is never gathered.
    """
    top = edges.groupBy("src").agg(F.max(F.log1p("cnt")).alias("_m"))
    return edges.join(top, "src").select("src", "dst", (F.log1p("cnt") / F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0)).alias("w"))


def rings(edges: DataFrame, sources: DataFrame | None = None, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(src, hop, item)`` of rings 1 to ``depth``, and ``(src, item)`` of everything visited, the source included.

    A hub is hot on both sides of the step: its successors are cut into parts of ``HUB``, and its predecessors are sent to each of them, so no
    task holds the whole product. The distinct pairs are combined within each task before they are shuffled.

    Ring 1 is the adjacency with self-loops; ring h holds what is reached from ring h-1 and was not visited before. Only ``sources``
    are expanded, always over the whole graph. Each ring is kept once, as the next one reads it twice.
    """
    adj = adjacency(edges)
    start = adj if sources is None else adj.join(sources.select("src").distinct(), "src", "left_semi")
    roots = start.select("src").distinct() if sources is None else sources.select("src").distinct()
    ring = cut(start.select("src", F.col("dst").alias("item")))
    out = ring.select("src", F.lit(1).alias("hop"), "item")
    visited = ring.unionByName(roots.select("src", F.col("src").alias("item"))).distinct()
    width = adj.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / F.lit(HUB)).cast("int").alias("parts"))
    step = cut(adj.join(width, "src").select(F.col("src").alias("item"), F.col("dst").alias("next"), "parts", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part")))
    width = width.select(F.col("src").alias("item"), "parts")
    for h in range(2, depth + 1):
        sent = ring.join(width, "item").select("src", "item", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        reached = sent.join(step, ["item", "part"]).select("src", F.col("next").alias("item")).distinct()
        ring = cut(reached.join(visited, ["src", "item"], "left_anti"))
        out = out.unionByName(ring.select("src", F.lit(h).alias("hop"), "item"))
        visited = visited.unionByName(ring) if h == depth else cut(visited.unionByName(ring))
    return out, visited


def packed(edges: DataFrame) -> DataFrame:
    """``src, dsts, cnts``: the edges of a source in a few rows of lists, which take a quarter of the space; sorted by source and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            src = b.column("src")
            at = np.concatenate([[0], np.flatnonzero(np.asarray(pa.compute.not_equal(src[1:], src[:-1]).fill_null(True))) + 1, [len(src)]])
            ends = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([src.take(pa.array(at[:-1])), pa.ListArray.from_arrays(ends, b.column("dst")), pa.ListArray.from_arrays(ends, b.column("cnt"))], names=["src", "dsts", "cnts"])

    rows = edges.select(*(F.col(c).cast("bigint") for c in ("src", "dst", "cnt")))
    return cut(rows.repartition("src").sortWithinPartitions("src").mapInArrow(run, "src bigint, dsts array<bigint>, cnts array<bigint>"))


def unpacked(lists: DataFrame) -> DataFrame:
    """``src, dst, cnt`` again, and what else ``lists`` holds."""
    more = [c for c in lists.columns if c not in ("src", "dsts", "cnts")]
    return lists.select("src", *more, F.explode(F.arrays_zip("dsts", "cnts")).alias("_x")).select("src", F.col("_x.dsts").alias("dst"), F.col("_x.cnts").alias("cnt"), *more)


def reached_twice(lists: DataFrame, own: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """``src, hot, item``: ring 2 of each of ``roots`` (src, hot); where ``hot`` is false, only the k smallest ids of it.

    ``own``: the rows of ``lists`` of the roots, with ``hot``. Lists are sent as they are, and the pairs are told apart where they meet: in place of
    a row for each pair that is reached, there are one for each list and those that are asked for.
    """
    sent = unpacked(own).select("src", "hot", F.col("dst").alias("item")).join(lists.select(F.col("src").alias("item"), F.col("dsts").alias("ids")), "item").select("src", "hot", F.lit(1).alias("f"), "ids")
    seen = own.select("src", "hot", F.lit(0).alias("f"), F.col("dsts").alias("ids")).unionByName(roots.select("src", "hot", F.lit(0).alias("f"), F.array("src").alias("ids")))

    def told(src: np.ndarray, hot: np.ndarray, f: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """Of sorted, whole sources: an element a place."""
        new = np.concatenate([[True], src[1:] != src[:-1]])
        s, first = np.cumsum(new) - 1, np.flatnonzero(new)
        if 0 <= ids.min() and ids.max() < 1 << 40 and len(first) < 1 << 22:
            key = np.sort((s << 41) | (ids << 1) | f)
            s, ids, f = key >> 41, (key >> 1) & ((1 << 40) - 1), key & 1
        else:
            order = np.lexsort((f, ids, s))
            s, ids, f = s[order], ids[order], f[order]
        fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (s[1:] != s[:-1])]) & (f == 1)
        s, ids = s[fresh], ids[fresh]
        keep = hot[first][s] | (np.arange(len(s)) - np.searchsorted(s, s) < k)
        s, ids = s[keep], ids[keep]
        return pa.RecordBatch.from_arrays([pa.array(src[first][s]), pa.array(hot[first][s]), pa.array(ids)], names=["src", "hot", "item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            ids = b.column("ids")
            n = np.asarray(pa.compute.list_value_length(ids))
            if not n.sum():
                continue
            now = [np.repeat(b.column(c).to_numpy(zero_copy_only=False), n) for c in ("src", "hot", "f")] + [ids.flatten().to_numpy()]
            last = np.searchsorted(now[0], now[0][-1])
            if held and (last or held[-1][0][-1] != now[0][-1]):  # a source is over
                yield told(*(np.concatenate(x) for x in zip(*held, tuple(x[:last] for x in now))))
                held = []
            elif last:
                yield told(*(x[:last] for x in now))
            held.append(tuple(x[last:] for x in now))
            if sum(len(x[0]) for x in held) > 1 << 22:  # one source that reaches very much: each id once
                src, hot, f, ids = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((f, ids))
                order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
                held = [(src[order], hot[order], f[order], ids[order])]
        if held:
            yield told(*(np.concatenate(x) for x in zip(*held)))

    return sent.unionByName(seen).repartition("src").sortWithinPartitions("src").mapInArrow(run, "src bigint, hot boolean, item bigint")


def outside_sizes(users: DataFrame, visited: DataFrame, n_items: int) -> DataFrame:
    """``user, n``: how many ids of 0 .. n_items - 1 are neither visited from the user's source nor in the user's history.

    ``users``: ``user, src, history``. The ids themselves are never listed; ``ranking.complement_top`` picks the best of them.
    """
    inside = visited.filter(F.col("item").between(0, n_items - 1)).distinct()
    seen = inside.groupBy("src").agg(F.count(F.lit(1)).alias("_s"))
    own = users.select("user", "src", F.explode(F.array_distinct("history")).alias("item")).filter(F.col("item").between(0, n_items - 1))
    own = own.join(inside, ["src", "item"], "left_anti").groupBy("user").agg(F.count(F.lit(1)).alias("_h"))
    both = users.select("user", "src").join(seen, "src", "left").join(own, "user", "left")
    return both.select("user", (F.lit(n_items) - F.coalesce("_s", F.lit(0)) - F.coalesce("_h", F.lit(0))).alias("n"))


def hop_degrees(rings_: DataFrame) -> DataFrame:
    """``src, hop, n``: ring sizes."""
    return rings_.groupBy("src", "hop").agg(F.count(F.lit(1)).alias("n"))

