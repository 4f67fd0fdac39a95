"""Most similar vectors for every vector: a small-world graph per shard, shard results merged.

Vectors are routed to cells by a balanced tree of centroids that is fitted on a bounded sample; every vector is indexed in its own cell
and searches the graphs of its closest cells. How many these must be is measured on a sample of queries with exact neighbours. Cells that turn out too large are salted into several shards, all of
which are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.hnsw import Graph
from seqloom.operators.ordering import top_per_key
from seqloom.runtime import cut, spread_keys

#: Vectors of a shard and queries of a task.
SHARD_VECTORS, BLOCK = 16_384, 65_536
#: Rows of the sample that one tree of cells is fitted on, and rows of it that a cell needs. More cells than that allows are fitted in two
#: levels: a tree over all vectors, and below each of its cells a tree fitted by a task of its own on a sample of that cell.
SAMPLE, CELL_SAMPLE = 32_768, 64
#: A query visits as many cells as hold this share of the true neighbours of a sample of so many queries.
ROUTED, QUERIES = 0.96, 512
#: Neighbours per node (twice as many on level 0), and beam widths of build and search.
DEGREE, EF_BUILD, EF_SEARCH = 16, 48, 96
_PART = 4 << 20  # bytes of a piece of a stored graph


def hashed_sample(df: DataFrame, n: int, most: int, *salt: Column) -> DataFrame:
    """``most`` rows of ``df``, which has about ``n``, by the hash of their ``k``. Tasks send the driver few more than these, however many tasks there are."""
    h = F.xxhash64("k", *salt)
    few = df.filter(h <= F.lit(int(-(2**63) + min(1.0, 4 * most / max(n, 1)) * (2**64 - 2**12)))) if n > 4 * most else df
    if n > 4 * most and few.count() < most:
        few = df
    return few.orderBy(h).limit(most)


def usable_arrays(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``k, e``: each non-null id with its vector as it is; see ``usable_vectors``."""
    e = F.col(vector)
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(key).isNotNull() & (F.size(e) == dim) & ~odd & F.exists(e, lambda x: x != 0)).groupBy(F.col(key).alias("k")).agg(F.min(e).alias("e"))


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``k, v``: each non-null id with its vector in unit length, as float32 bytes.

    Vectors that are null, all-zero, of another dimension, or that hold a null, NaN or infinite element are left out. Of
    different usable vectors of one id, the smallest in array order stays.
    """
    ok = usable_arrays(df, key, vector, dim)
    kind = dict(ok.dtypes)["k"]

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.asarray(b.column("e").flatten(), np.float64).reshape(-1, dim)
            flat = flat / np.abs(flat).max(1, keepdims=True)
            flat = (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([r.tobytes() for r in flat], pa.binary())], names=["k", "v"])

    return ok.mapInArrow(unit, f"k {kind}, v binary")


def centroid_tree(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of ``cells`` groups of nearly equal size: the largest group is bisected until there are enough."""
    rng = np.random.default_rng(seed)
    groups = [x]
    while len(groups) < cells:
        k = max(range(len(groups)), key=lambda i: len(groups[i]))
        g = groups[k]
        if len(g) < 2:
            break
        a, b = g[rng.choice(len(g), 2, replace=False)]
        for _ in range(8):
            side = g @ (a - b)
            half = side >= np.median(side)
            if half.all() or not half.any():
                half = np.arange(len(g)) % 2 == 0
            a, b = g[half].mean(0), g[~half].mean(0)
        groups[k : k + 1] = [g[half], g[~half]]
    return np.stack([g.mean(0) for g in groups]).astype(np.float32)


def closest_cells(x: np.ndarray, centroids: np.ndarray, visits: int) -> np.ndarray:
    """Numbers of the ``visits`` closest centroids of each row, closest first; rows are taken in blocks, so that memory stays the same for any number of cells."""
    out = np.empty((len(x), visits), np.int32)
    half = 0.5 * (centroids**2).sum(1)
    step = max(1, 4_194_304 // len(centroids))
    for a in range(0, len(x), step):
        s = half - x[a : a + step] @ centroids.T
        near = np.argpartition(s, visits - 1, axis=1)[:, :visits] if visits < len(centroids) else np.broadcast_to(np.arange(len(centroids)), s.shape)
        out[a : a + step] = np.take_along_axis(near, np.argsort(np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    return out


def fit_cells(index: DataFrame, n: int, dim: int, shard_vectors: int, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of about ``n`` / ``shard_vectors`` cells, as many as the vectors ask for: 4 * dim bytes a cell."""
    spark = index.sparkSession
    cells, most = -(-n // shard_vectors), max(2, sample // CELL_SAMPLE)
    rows = hashed_sample(index, n, sample).select("v").collect()  # bounded
    top = centroid_tree(np.frombuffer(b"".join(bytes(r["v"]) for r in rows), np.float32).reshape(-1, dim), min(cells, most))
    if cells <= most:
        return top
    sent = spark.sparkContext.broadcast(top)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("v").to_pylist()), np.float32).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("v"), pa.array(closest_cells(x, sent.value, 1)[:, 0])], names=["k", "v", "c"])

    homes = index.mapInArrow(home, "k bigint, v binary, c int")
    sizes = {r["c"]: r["n"] for r in homes.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cell of the upper tree
    want = {c: -(-m // shard_vectors) for c, m in sizes.items()}
    counts = F.broadcast(spark.createDataFrame([(c, m, want[c]) for c, m in sizes.items()], "c int, n bigint, parts int"))
    # a hash keeps about as many rows of each cell as its tree needs
    share = F.least(F.lit(1.0), F.lit(float(2 * CELL_SAMPLE)) * F.col("parts") / F.col("n"))
    kept = homes.join(counts, "c").filter((F.pmod(F.xxhash64("k"), F.lit(1_000_003)) / 1_000_003 < share) | (F.col("parts") == 1))
    kept = kept.filter("parts > 1").select("c", "parts", "v")

    def below(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(-1, dim)
        return pd.DataFrame({"v": [r.tobytes() for r in centroid_tree(x, int(pdf["parts"].iloc[0]))]})

    fitted = kept.groupBy("c").applyInPandas(below, "v binary").collect()  # a row per cell
    single = top[[c for c, m in want.items() if m == 1]]
    return np.concatenate([single, np.frombuffer(b"".join(bytes(r["v"]) for r in fitted), np.float32).reshape(-1, dim)])


def visits_needed(index: DataFrame, queries: list, centroids: np.ndarray, k: int, share: float = ROUTED) -> int:
    """The least number of closest cells that hold ``share`` of the exact k nearest of ``queries`` (rows of ``k, v``), which are compared with all of ``index``."""
    dim = centroids.shape[1]
    queries = sorted(queries, key=lambda r: r["k"])
    own = np.array([r["k"] for r in queries], np.int64)
    q = np.frombuffer(b"".join(bytes(r["v"]) for r in queries), np.float32).reshape(-1, dim)
    sent = index.sparkSession.sparkContext.broadcast((own, q, centroids))

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_, q_, c = sent.value
        sims, cells = np.full((len(q_), k), -np.inf, np.float32), np.full((len(q_), k), -1, np.int32)
        for b in batches:
            x = np.frombuffer(b"".join(b.column("v").to_pylist()), np.float32).reshape(-1, dim)
            if not len(x):
                continue
            keys = b.column("k").to_numpy()
            home = closest_cells(x, c, 1)[:, 0]
            s = q_ @ x.T
            at = np.minimum(np.searchsorted(own_, keys), len(own_) - 1)
            same = np.flatnonzero(own_[at] == keys)
            s[at[same], same] = -np.inf
            s, h = np.concatenate([sims, s], 1), np.concatenate([cells, np.broadcast_to(home, s.shape)], 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            sims, cells = np.take_along_axis(s, top, 1), np.take_along_axis(h, top, 1)
        i, j = np.nonzero(np.isfinite(sims))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(sims[i, j], pa.float32()), pa.array(cells[i, j], pa.int32())], names=["q", "s", "c"])

    found = index.select("k", "v").mapInArrow(closest, "q int, s float, c int")
    rows = top_per_key(found, ["q"], [F.desc("s"), "c"], k, "r").select("q", "c").collect()  # k rows a query
    place = np.argsort(np.argsort(-(q @ centroids.T - 0.5 * (centroids**2).sum(1)), axis=1, kind="stable"), axis=1)
    ranks = np.array([place[r["q"], r["c"]] for r in rows], int)
    held = np.cumsum(np.bincount(ranks, minlength=len(centroids))) / max(len(ranks), 1)
    return int(np.argmax(held >= share)) + 1 if len(ranks) else 1


def nearest_neighbours(
    df: DataFrame,
    key: str,
    vector: str,
    k: int = 10,
    dim: int | None = None,
    shard_vectors: int = SHARD_VECTORS,
    probes: int | None = None,
    ef: int = EF_SEARCH,
) -> DataFrame:
    """``item_id, rank, neighbour, cosine``: the k most similar other items of every item with a usable vector, by cosine.

    See ``usable_vectors`` for what is usable; without ``dim``, the most frequent dimension is taken. Repeated rows
    count once, ties in cosine go to the smaller id, an item with fewer than k others gets fewer rows, and no usable vector gives no
    rows. Of items with one and the same vector, the k + 1 smallest ids are indexed, as no other can be in anyone's
    list before these; the others take the first k of them. ``probes``: cells that a query visits; by default as many as ``visits_needed`` says.
    """
    spark = df.sparkSession
    schema = "item_id bigint, rank int, neighbour bigint, cosine float"
    if dim is None:
        top = df.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
        if top is None:
            return spark.createDataFrame([], schema)
        dim = top["d"]
    vecs = cut(usable_vectors(df, key, vector, dim).select(F.col("k").cast("bigint").alias("k"), "v"))
    n = vecs.count()
    if n == 0:
        return spark.createDataFrame([], schema)

    copies = vecs.groupBy(F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    index, rest = vecs, None
    if not copies.isEmpty():
        from pyspark.sql import Window

        many = vecs.withColumn("h", F.xxhash64("v")).join(copies, "h", "left_semi").select("k", "v")
        first = cut(many.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("k"))).filter(F.col("r") <= k + 1).drop("r"))
        rest = many.join(first.select("k"), "k", "left_anti")
        lists = first.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("k")), 1, k).alias("ids"))  # k + 1 rows a group at most
        rest = rest.join(lists, "v").select(F.col("k").alias("item_id"), F.posexplode("ids").alias("rank", "neighbour")).select("item_id", (F.col("rank") + 1).alias("rank"), "neighbour", F.lit(1.0).cast("float").alias("cosine"))
        index = cut(vecs.join(rest.select(F.col("item_id").alias("k")), "k", "left_anti"))

    if n > shard_vectors:
        centroids = fit_cells(index, n, dim, shard_vectors)
        if probes is None:
            rows = hashed_sample(index, n, QUERIES, F.lit(1)).select("k", "v").collect()  # bounded
            probes = visits_needed(index, rows, centroids, k)
    else:
        centroids = np.zeros((1, dim), np.float32)
    cells = len(centroids)
    c = spark.sparkContext.broadcast(centroids)
    visits = min(probes or 1, cells)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("v").to_pylist()), np.float32).reshape(-1, dim)
            order = closest_cells(x, c.value, visits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, visits), pa.int32()), pa.array(order.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("v"), lists], names=["k", "v", "cells"])

    routed = cut(index.mapInArrow(route, "k bigint, v binary, cells array<int>"))
    homes = {r["c"]: r["n"] for r in routed.groupBy(F.col("cells")[0].alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cell
    calls = {r["c"]: r["n"] for r in routed.select(F.explode("cells").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = {x: max(1, -(-m // (2 * shard_vectors))) for x, m in homes.items()}
    shards = sum(salts.values())
    # Queries of a shard go to as many tasks as their number asks for, and to more where there would be fewer tasks than cores.
    least = -(-2 * spark.sparkContext.defaultParallelism // shards)
    blocks = {x: max(1, -(-calls.get(x, 0) // BLOCK), min(least, -(-calls.get(x, 0) // 1024))) for x in homes}
    shard_list = [(x, s) for x in sorted(homes) for s in range(salts[x])]
    groups = [(x, s, b) for x, s in shard_list for b in range(blocks[x])]
    plan = F.broadcast(spark.createDataFrame([(x, salts[x], blocks[x]) for x in homes], "c int, salts int, blocks int"))
    shard_keys = F.broadcast(spark.createDataFrame([(*x, g) for x, g in zip(shard_list, spread_keys(spark, len(shard_list)))], "c int, salt int, g bigint"))
    group_keys = F.broadcast(spark.createDataFrame([(*x, g) for x, g in zip(groups, spread_keys(spark, len(groups)))], "c int, salt int, block int, g bigint"))

    base = routed.withColumn("c", F.col("cells")[0]).join(plan, "c").withColumn("salt", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int"))
    base = base.join(shard_keys, ["c", "salt"]).select("k", "v", "cells", "c", "salt", "g").repartition(len(shard_list), "g")
    wide = 2 * k + 2  # holds the query itself and, at the k-th place, all copies of one vector
    beam = max(ef, wide)
    further = visits > 1 or max(salts.values()) > 1

    def lists(g: Graph, ids: np.ndarray, keys: np.ndarray, q: np.ndarray, **how: np.ndarray) -> dict[str, list]:
        i, s = g.search(q, wide, beam, **how)
        got = np.where(i >= 0, ids[i], -1)
        order = np.lexsort((got, -s), axis=1)
        i, s, got = (np.take_along_axis(x, order, 1) for x in (i, s, got))
        ok = (i >= 0) & (got != keys[:, None])
        return {"ids": [a[o][:k] for a, o in zip(got, ok)], "sims": [a[o][:k] for a, o in zip(s, ok)]}

    # A vector searches the shard that it is in, starting from itself, as soon as the graph is there. What its beam holds at the end is the
    # floor for all other shards: below it nothing can be of use.
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        q = np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(-1, dim)
        ids = pdf["k"].to_numpy(np.int64)
        g = Graph.build(q, DEGREE, EF_BUILD)
        found = lists(g, ids, ids, q, entry=np.arange(len(ids)))
        out = pdf[["c", "salt", "k", "v", "cells"]].assign(**found, floor=np.where(np.isfinite(g.last), g.last, -2.0)).astype({"k": object})
        if not further:
            return out.assign(part=None, data=None)
        data = len(ids).to_bytes(8, "little") + ids.tobytes() + g.dump()
        parts = [data[i : i + _PART] for i in range(0, len(data), _PART)]
        flat = pd.DataFrame({"c": pdf["c"].iloc[0], "salt": pdf["salt"].iloc[0], "part": range(len(parts)), "data": parts})
        return pd.DataFrame({x: [*(out[x] if x in out else [None] * len(out)), *(flat[x] if x in flat else [None] * len(flat))] for x in ("c", "salt", "part", "data", "k", "ids", "sims", "v", "cells", "floor")}, dtype=object)

    kept = "k bigint, ids array<bigint>, sims array<float>"
    # the expensive step: lost executors must not cause it to be done again
    built = cut(base.groupBy("g").applyInPandas(build, f"c int, salt int, part int, data binary, {kept}, v binary, cells array<int>, floor float"))
    first = built.filter("k IS NOT NULL")
    found = first.select("k", "ids", "sims")
    if further:
        spread = built.filter("part IS NOT NULL").select("c", "salt", "part", "data").join(group_keys, ["c", "salt"]).select("g", "part", "data").repartition(len(groups), "g")
        away = first.select("k", "v", "floor", F.col("c").alias("own"), F.col("salt").alias("own_salt"), F.explode("cells").alias("c")).join(plan, "c")
        away = away.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).filter("c <> own OR salt <> own_salt")
        away = away.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).join(group_keys, ["c", "salt", "block"]).select(F.col("g").alias("h"), "k", "v", "floor").repartition(len(groups), "h")

        def search(parts: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            if not len(parts) or not len(queries):
                return pd.DataFrame({x: [] for x in ("k", "ids", "sims")})
            data = b"".join(parts.sort_values("part")["data"])
            m = int.from_bytes(data[:8], "little")
            q, keys = np.frombuffer(b"".join(queries["v"]), np.float32).reshape(-1, dim), queries["k"].to_numpy(np.int64)
            got = lists(Graph.load(data[8 + 8 * m :]), np.frombuffer(data[8 : 8 + 8 * m], np.int64), keys, q, floor=queries["floor"].to_numpy(np.float32))
            return pd.DataFrame({"k": keys, **got})

        found = found.unionByName(spread.groupBy("g").cogroup(away.groupBy("h")).applyInPandas(search, kept))

    def best(rows: DataFrame) -> DataFrame:
        """The k best distinct neighbours of each item; ``rows`` holds a bounded number of short lists an item."""
        return rows.groupBy("k").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("b")))), 1, k).alias("b"))

    zipped = F.arrays_zip(F.transform("sims", lambda x: -x).alias("s"), F.col("ids").alias("i"))
    merged = cut(best(found.select("k", zipped.alias("b"))))  # at most probes * salts lists
    # Similarity has no direction: what one item found, the other may have missed. An item that is in very many lists keeps its best k.
    back = merged.select("k", F.explode("b").alias("x")).select(F.col("x.i").alias("k"), F.col("k").alias("id"), F.col("x.s").alias("s"))
    back = top_per_key(back, ["k"], ["s", "id"], k, "r").select("k", F.array(F.struct("s", F.col("id").alias("i"))).alias("b"))
    merged = best(merged.unionByName(back))
    out = merged.select(F.col("k").alias("item_id"), F.posexplode("b").alias("p", "x")).select("item_id", (F.col("p") + 1).alias("rank"), F.col("x.i").alias("neighbour"), (-F.col("x.s")).alias("cosine"))
    return out.unionByName(rest) if rest is not None else out
