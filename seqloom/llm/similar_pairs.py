"""All pairs of vectors whose cosine reaches a stated bound.

Pairs that are this close meet in small buckets: each of several hash tables turns all vectors by random rotations and takes the axis that a
vector lies closest to. How many tables it takes is measured on made pairs that lie exactly at the bound, the hardest ones. Within a
bucket all vectors are compared, in one byte per element with the error of that accounted for, and what is left is decided in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.neighbours import hashed_sample, usable_arrays
from seqloom.operators.vectors import dot, norm
from seqloom.runtime import cut

#: Up to so many vectors are one bucket of one table, which leaves nothing out; beyond, buckets hold about ``BUCKET`` of them.
WHOLE, BUCKET = 16_384, 2048
#: There are as many tables as bring this share of the pairs at the bound together, measured on so many made pairs. A round has ``ROUND`` tables, so
#: that the shuffled bytes on disk at a time don't grow with the number of tables.
SHARE, TRIALS, ROUND, MOST_TABLES = 0.999, 20_000, 8, 256


def rotations(n: int, dim: int, table: int, bucket: int = BUCKET) -> list[np.ndarray]:
    """Axes of one table (dim x axes each): together they tell about ``n`` / ``bucket`` buckets apart, two for each axis."""
    rng, left, out = np.random.default_rng([7, table]), -(-n // bucket), []
    while left > 1:
        w = min(dim, -(-left // 2))
        out.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :w].astype(np.float32))
        left = -(-left // (2 * w))
    return out


def bucket_of(x: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
    """Numbers of the buckets that rows fall into."""
    out = np.zeros(len(x), np.int64)
    for m in axes:
        p = x @ m
        j = np.abs(p).argmax(1)
        out = out * (2 * m.shape[1]) + 2 * j + (p[np.arange(len(p)), j] < 0)
    return out


def pairs_at(x: np.ndarray, least: float, m: int = TRIALS) -> tuple[np.ndarray, np.ndarray]:
    """``m`` made pairs with a cosine of ``least``: rows of ``x``, moved in the directions in which rows of ``x`` differ."""
    rng = np.random.default_rng(11)
    a, b, c = (x[rng.integers(0, len(x), m)].astype(np.float64) for _ in range(3))
    u = b - c
    u -= (u * a).sum(1, keepdims=True) * a
    size = np.linalg.norm(u, axis=1)
    ok = size > 1e-6
    a, u = a[ok], u[ok] / size[ok, None]
    return a.astype(np.float32), (least * a + np.sqrt(1 - least**2) * u).astype(np.float32)


def tables_needed(x: np.ndarray, n: int, least: float, centre: np.ndarray, bucket: int = BUCKET, share: float = SHARE) -> int:
    """The least number of tables of which one at least brings ``share`` of the pairs at the bound into one bucket."""
    a, b = pairs_at(x, least)
    met = np.zeros(len(a), bool)
    for t in range(MOST_TABLES):
        axes = rotations(n, x.shape[1], t, bucket)
        met |= bucket_of(a - centre, axes) == bucket_of(b - centre, axes)
        if not len(met) or met.mean() >= share:
            return t + 1
    raise ValueError(f"{MOST_TABLES} tables don't bring {share} of the pairs at {least} together")


def unit(flat: np.ndarray) -> np.ndarray:
    flat = flat.astype(np.float64)
    flat /= np.abs(flat).max(1, keepdims=True)
    return (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


def close_within(x: np.ndarray, least: float, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of all pairs of rows with a product of at least ``least``; memory stays the same for any number of rows."""
    for a in range(0, len(x), block):
        rows = x[a : a + block]
        for b in range(a, len(x), 8 * block):
            i, j = np.nonzero(rows @ x[b : b + 8 * block].T >= least)
            ok = i + a < j + b
            yield i[ok] + a, j[ok] + b


def similar_pairs(df: DataFrame, key: str, vector: str, least: float, dim: int | None = None, whole: int = WHOLE, bucket: int = BUCKET) -> DataFrame:
    """``item_a, item_b`` with item_a < item_b: all pairs of items whose vectors have a cosine of at least ``least``, however many an item has.

    ``neighbours.usable_vectors`` says which vectors count. Up to ``whole`` vectors are compared with each other; of more, a pair whose cosine is
    ``least`` itself is met with a probability of ``SHARE``, closer ones with a higher one. What is given is right to double precision.
    """
    spark = df.sparkSession
    if dim is None:
        top = df.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = top["d"] if top else 1
    vecs = cut(usable_arrays(df, key, vector, dim).select(F.col("k").cast("bigint").alias("k"), "e"))
    n = vecs.count()
    tables, centre = 1, np.zeros(dim, np.float32)
    if n > whole:
        rows = hashed_sample(vecs, n, 8192).select("e").collect()  # bounded
        x = unit(np.array([r["e"] for r in rows]))
        centre = x.mean(0)
        tables = tables_needed(x, n, least, centre, bucket)
    size = bucket if n > whole else max(n, 1)

    def spread(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            axes = [rotations(n, dim, t, size) for t in range(first, last)]
            for b in batches:
                x = unit(np.asarray(b.column("e").flatten()).reshape(-1, dim))
                step = np.abs(x).max(1, keepdims=True) / 127
                small = np.rint(x / step).astype(np.int8)
                off = np.linalg.norm(x - small * step, axis=1).astype(np.float32) + np.float32(1e-5)  # how far the short form is off at most
                data = np.ascontiguousarray(np.concatenate([step.astype(np.float32).view(np.int8), small], 1))
                at = pa.py_buffer(np.arange(0, (len(x) + 1) * (dim + 4), dim + 4, dtype=np.int32))
                q = pa.Array.from_buffers(pa.binary(), len(x), [None, at, pa.py_buffer(data)])
                for t, m in zip(range(first, last), axes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(bucket_of(x - centre, m)), b.column("k"), q, pa.array(off)], names=["t", "h", "k", "q", "off"])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their buckets; the last bucket of a batch may go on in the next."""
        held: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, off = rows.column("k").to_numpy(), rows.column("off").to_numpy()
            raw = np.frombuffer(b"".join(rows.column("q").to_pylist()), np.int8).reshape(-1, dim + 4)
            x = raw[:, 4:] * np.ascontiguousarray(raw[:, :4]).view(np.float32)
            for i, j in close_within(x, least - 2.0 * float(off.max()) - float(off.max()) ** 2):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["item_a", "item_b"])

        for b in batches:
            if not b.num_rows:
                continue
            t, h = b.column("t").to_numpy(), b.column("h").to_numpy()
            ends = np.flatnonzero((t[1:] != t[:-1]) | (h[1:] != h[:-1])) + 1
            if held and (held[-1].column("t")[-1].as_py(), held[-1].column("h")[-1].as_py()) != (t[0], h[0]):
                ends = np.concatenate([[0], ends])
            at = 0
            for end in ends:
                held.append(b.slice(at, end - at))
                yield from pairs(pa.Table.from_batches([r for r in held if r.num_rows]))
                held, at = [], end
            held.append(b.slice(at))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    pairs = None
    for first in range(0, tables, ROUND):
        sent = vecs.mapInArrow(spread(first, min(tables, first + ROUND)), "t int, h bigint, k bigint, q binary, off float")
        met = sent.repartition("t", "h").sortWithinPartitions("t", "h").mapInArrow(meet, "item_a bigint, item_b bigint").distinct()
        met = cut(met)
        pairs = met if pairs is None else pairs.unionByName(met)
    a, b = (vecs.select(F.col("k").alias(f"item_{s}"), F.col("e").alias(f"e_{s}")) for s in "ab")
    both = pairs.distinct().join(a, "item_a").join(b, "item_b").select("item_a", "item_b", (dot(F.col("e_a"), F.col("e_b")) / (norm(F.col("e_a")) * norm(F.col("e_b")))).alias("cosine"))
    return both.filter(F.col("cosine") >= least).select("item_a", "item_b")
