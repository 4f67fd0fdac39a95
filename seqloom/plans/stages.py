"""The stages over prepared folders: what is read, built where it is missing, and checked."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import config
from seqloom.operators import embed, graph, metrics, sinks
from seqloom.runtime import exists


def cached(spark: SparkSession, path: str | None, build: Callable[[], DataFrame]) -> DataFrame:
    """What is stored at ``path``; else it is built, stored there and read back. Without a path it is just built."""
    if path is None:
        return build()
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def load_split(spark: SparkSession, data: str, split: str) -> DataFrame:
    return spark.read.parquet(config.resolve_split(spark, data, split))


def load_graph(spark: SparkSession, data: str, overwrite: bool = False) -> DataFrame:
    """The transition graph below ``data``; where it is missing, it is counted from the training split and stored."""
    path = f"{data.rstrip('/')}/graph"
    if overwrite or not exists(spark, path):
        sinks.write_graph(graph.transitions(load_split(spark, data, "training"), "sequence_data", held_out=0), path, overwrite)
    return spark.read.parquet(path)


def embed_items(spark: SparkSession, data: Sequence[str], load: Callable[[], embed.Encoder], batch: int = 8, overwrite: bool = False) -> list[str]:
    """Encodes the items of each prepared folder into its ``embeddings``; returns the folders done. Missing ones and those that have vectors are passed over."""
    done = []
    for d in data:
        path = f"{d.rstrip('/')}/embeddings"
        if exists(spark, d) and (overwrite or not exists(spark, path)):
            items = load_split(spark, d, "items")
            sinks.write_embeddings(embed.embed(items, "item_id", "text", load, batch), "item_id", "embedding", path, overwrite)
            done.append(d)
    return done


def check(spark: SparkSession, data: str, name: str, quick: bool = False) -> tuple[str, str]:
    """``(status, note)`` of one prepared folder: MISSING, INCOMPLETE, PRESENT (with ``quick``), MISMATCH or OK."""
    e = config.REGISTRY[name]
    if not exists(spark, data, folder=True):
        return "MISSING", "not prepared"
    lost = [s for s in config.SPLIT_NAMES if config.resolve_split(spark, data, s, required=False) is None]
    if lost:
        return "INCOMPLETE", f"no {', '.join(lost)}"
    notes = [f"no {what}" for what in ("embeddings", "graph") if not exists(spark, f"{data.rstrip('/')}/{what}")]
    if quick:
        return "PRESENT", "; ".join(notes) or "files present"
    stats = metrics.dataset_stats(load_split(spark, data, "testing"), "sequence_data", load_split(spark, data, "items"))
    expected = {"n_users": e.users, "n_items": e.items, "avg_len": e.avg_len}
    if "no graph" not in notes:
        stats = stats.withColumn("n_edges", load_graph(spark, data).agg(F.count(F.lit(1))).scalar())
        expected["n_edges"] = e.edges
    rows = metrics.verify(stats, expected).collect()
    wrong = [f"{r['name']} {r['found']:g} != {r['expected']:g}" for r in rows if r["status"] != "OK"]
    return ("MISMATCH", "; ".join(wrong)) if wrong else ("OK", "; ".join(notes))
