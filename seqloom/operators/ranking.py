"""Scoring ring candidates and taking the best of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordering import top_per_key
from seqloom.operators.vectors import dot
from seqloom.runtime import cut

#: Scores are ranked to so many digits, ties by item; sums of floats can then not flip a rank.
DIGITS = 9


def score(cands: DataFrame, anchors: DataFrame, vectors: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, key: str = "q") -> DataFrame:
    """Adds ``score`` to candidates ``(q, src, hop, item)``: cosine to the anchor, plus alpha times the edge weight on ring 1.

    ``anchors``: ``q, anchor``; ``vectors``: ``item, e`` in unit length. A missing anchor or vector gives a cosine of 0.
    """
    out = cands.join(anchors, key, "left").join(vectors, "item", "left")
    cos = F.coalesce(dot(F.col("anchor"), F.col("e")), F.lit(0.0))
    if weights is not None and alpha > 0:
        w = weights.select("src", F.col("dst").alias("item"), "w", F.lit(1).alias("hop"))
        out = out.join(w, ["src", "hop", "item"], "left")
        cos = cos + alpha * F.coalesce("w", F.lit(0.0))
    return out.withColumn("score", F.round(cos, DIGITS)).select(*cands.columns, "score")


def top_per_ring(scored: DataFrame, k: int, key: str = "q") -> DataFrame:
    """The k best candidates of each (q, hop) with ``rank``."""
    return top_per_key(scored, [key, "hop"], [F.desc("score"), "item"], k)


def without(ranked: DataFrame, taken: DataFrame, k: int, key: str = "q") -> DataFrame:
    """Ranked candidates minus ``(q, item)`` already taken, ranked anew up to k. Exact if ``ranked`` holds k plus the number taken."""
    return top_per_ring(ranked.drop("rank").join(taken, [key, "item"], "left_anti"), k, key)


def complement_top(queries: DataFrame, excluded: DataFrame, vectors: DataFrame, n_items: int, k: int, block: int = 65_536, chunk: int = 4096) -> DataFrame:
    """``q, rank, item, score``: the k ids of 0 .. n_items - 1 closest to each query's anchor that it doesn't exclude.

    ``queries``: ``q, anchor`` (null = zero vector), ``excluded``: ``q, item``, ``vectors``: ``item, e`` (none = zero vector). The stated queries meet
    all vectors in blocks: stacked chunks of queries are multiplied with stacked blocks of vectors, an exclusion goes to its own
    block alone, and only k rows a query leave each product. The complement itself is never listed.
    """
    first = vectors.select(F.size("e").alias("d")).first()
    dim, blocks = (first["d"] if first else 1), -(-n_items // block)
    parts = max(1, -(-queries.count() // chunk))
    kind = dict(queries.dtypes)["q"]
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int").alias("c")

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.zeros(dim) if x is None else np.asarray(x, float) for x in pdf["v"]]
        return pd.DataFrame({"g": [int(pdf["g"].iloc[0])], "ids": [pdf["id"].to_list()], "m": [np.stack(rows).tobytes()]})

    def stacked(rows: DataFrame, id_kind: str) -> DataFrame:
        return rows.groupBy("g").applyInPandas(stack, f"g int, ids array<{id_kind}>, m binary")

    inside = vectors.filter(F.col("item").between(0, n_items - 1))
    tall = cut(stacked(inside.select(F.floor(F.col("item") / block).cast("int").alias("g"), F.col("item").alias("id"), F.col("e").alias("v")), "bigint")).withColumnsRenamed({"g": "b", "ids": "items", "m": "mv"})
    wide = stacked(queries.select(cell("q").alias("g"), F.col("q").alias("id"), F.col("anchor").alias("v")), kind).withColumnsRenamed({"g": "c", "ids": "qs", "m": "mq"})
    gone = excluded.filter(F.col("item").between(0, n_items - 1)).select(cell("q"), F.floor(F.col("item") / block).cast("int").alias("b"), F.struct("q", "item").alias("x"))
    gone = gone.groupBy("c", "b").agg(F.collect_list("x").alias("gone"))  # of one chunk in one block
    pairs = wide.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(tall, "b", "left").join(gone, ["c", "b"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for at in range(t.num_rows):
                b, qs, mq, items, mv, out = (t.column(n)[at] for n in ("b", "qs", "mq", "items", "mv", "gone"))
                lo, names = b.as_py() * block, qs.values
                hi = min(lo + block, n_items)
                kk = min(k, hi - lo)
                anchors = np.frombuffer(mq.as_py()).reshape(-1, dim)
                cols = np.asarray(items.values) - lo if mv.is_valid else None
                stack_ = np.frombuffer(mv.as_py()).reshape(-1, dim).T if mv.is_valid else None
                gone_row, gone_col = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if out.is_valid:
                    row = {q: i for i, q in enumerate(names.to_pylist())}
                    gone_row = np.array([row.get(q, -1) for q in out.values.field("q").to_pylist()], np.int64)
                    gone_col = np.asarray(out.values.field("item"), np.int64) - lo
                for a in range(0, len(names), 64):
                    part = anchors[a : a + 64]
                    s = np.zeros((len(part), hi - lo))
                    if stack_ is not None:
                        s[:, cols] = part @ stack_
                    s = np.round(s, DIGITS) + 0.0
                    here = (gone_row >= a) & (gone_row < a + len(part))
                    s[gone_row[here] - a, gone_col[here]] = -np.inf
                    worst = -np.partition(-s, kk - 1, axis=1)[:, kk - 1 : kk]
                    i, j = np.nonzero((s >= worst) & np.isfinite(s))  # ties of the k-th place included
                    order = np.lexsort((j, -s[i, j], i))
                    i, j = i[order], j[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < kk
                    i, j = i[keep], j[keep]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i + a)), pa.array(j + lo, pa.int64()), pa.array(s[i, j])], names=["q", "item", "score"])

    found = pairs.select("b", "qs", "mq", "items", "mv", "gone").mapInArrow(run, f"q {kind}, item bigint, score double")
    return top_per_key(found, ["q"], [F.desc("score"), "item"], k).select("q", "rank", "item", "score")
