"""Writing prepared datasets: dense ids, splits, item catalogue, range shards, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.sequences import all_but, dense_ids, positions
from seqloom.runtime import cut, exists
from seqloom.sources.tfrecord import register

SPLITS = {"training": 2, "evaluation": 1, "testing": 0}


def shard_numbers(ids: DataFrame, key: str, parts: int) -> DataFrame:
    """Adds ``shard``: contiguous blocks of ceil(n / parts) ids; dense ids are expected."""
    n = ids.agg(F.count(F.lit(1))).scalar()
    return ids.withColumn("shard", F.floor(F.col(key) / F.greatest(F.ceil(n / F.lit(parts)), F.lit(1))).cast("bigint"))


def write_ranges(df: DataFrame, key: str, parts: int, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
    """One folder of at most ``parts`` files, each holding a contiguous range of ``key``. ``fmt``: parquet or tfrecord."""
    rows = df.repartitionByRange(parts, key).sortWithinPartitions(key)
    if fmt == "tfrecord":  # a Python source, which only knows append and overwrite
        register(df.sparkSession)
        if mode == "errorifexists" and exists(df.sparkSession, path):
            raise FileExistsError(path)
        mode = "append" if mode == "errorifexists" else mode
    rows.write.format(fmt).mode(mode).save(path)


def write_dataset(
    out: str,
    seqs: DataFrame,
    item_text: DataFrame,
    item_order: DataFrame | None = None,
    user_parts: int = 32,
    item_parts: int = 16,
    with_text: bool = False,
    mode: str = "errorifexists",
    fmt: str = "parquet",
) -> DataFrame:
    """Writes ``items``, the three splits and both id maps below ``out``; returns one row of statistics.

    ``seqs``: ``user_key, seq`` of item keys; ``item_text``: ``item_key, text``; ``item_order``: ``item_key, item_id`` to use instead of ids in
    key order. Raises ``KeyError`` if a sequence holds an item without an id or without a text. Users get ids in key order.
    Splits and items are written as ``fmt``. Sequences, texts and ids are computed once; the raw files are not read again for each output.
    """
    seqs, item_text = cut(seqs.select("user_key", "seq")), cut(item_text.select("item_key", "text"))
    ids = item_order if item_order is not None else cut(dense_ids(item_text, "item_key", "item_id"))
    used = seqs.select(F.explode("seq").alias("item_key")).distinct()
    for what, known in (("id", ids), ("text", item_text)):
        lost = used.join(known, "item_key", "left_anti").limit(5).collect()
        if lost:
            raise KeyError(f"items without {what}: {[r['item_key'] for r in lost]}")
    users = cut(dense_ids(seqs.select("user_key"), "user_key", "user_id"))
    catalogue = ids.join(item_text, "item_key", "left").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    base = out.rstrip("/")
    write_ranges(catalogue.withColumnRenamed("item_id", "id") if fmt == "tfrecord" else catalogue, "id" if fmt == "tfrecord" else "item_id", item_parts, f"{base}/items", mode, fmt)
    write_ranges(ids, "item_id", item_parts, f"{base}/item_ids", mode)
    write_ranges(users, "user_id", user_parts, f"{base}/user_ids", mode)
    long = positions(seqs, "user_key", "seq", "item_key").join(ids, "item_key").join(users, "user_key")
    if with_text:
        long = long.join(item_text, "item_key")
    cell = F.struct("pos", "item_id", *(["text"] if with_text else []))
    rows = long.groupBy("user_id").agg(F.array_sort(F.collect_list(cell)).alias("_s"))
    rows = cut(rows.select("user_id", F.col("_s.item_id").alias("sequence_data"), *([F.col("_s.text").alias("text")] if with_text else [])))
    for split, k in SPLITS.items():
        part = rows.withColumn("sequence_data", all_but(F.col("sequence_data"), k))
        if with_text:
            part = part.withColumn("text", all_but(F.col("text"), k))
        write_ranges(part, "user_id", user_parts, f"{base}/{split}", mode, fmt)
    done = rows.agg(F.count(F.lit(1)).alias("n_users"), F.sum(F.size("sequence_data")).alias("n_interactions"))
    return done.withColumn("n_items", catalogue.agg(F.count(F.lit(1))).scalar()).withColumn("avg_len", F.col("n_interactions") / F.col("n_users"))


def write_embeddings(vectors: DataFrame, item: str, vector: str, path: str, overwrite: bool = False) -> None:
    """``item_id, embedding`` sorted by id; an existing folder is left alone unless ``overwrite``."""
    rows = vectors.filter(F.col(item).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(item).alias("item_id")).agg(F.min(vector).alias("embedding"))
    rows.sort("item_id").write.mode("overwrite" if overwrite else "ignore").parquet(path)


def write_graph(edges: DataFrame, path: str, overwrite: bool = False) -> None:
    edges.select("src", "dst", "cnt").write.mode("overwrite" if overwrite else "ignore").parquet(path)


def write_predictions(rows: DataFrame, path: str, top_k: int = 10, mode: str = "errorifexists") -> None:
    """``user_id, item_ids, gt_ids`` with lists cut to ``top_k``."""
    rows.select("user_id", F.slice("items", 1, top_k).alias("item_ids"), F.array("target").alias("gt_ids")).write.mode(mode).parquet(path)
