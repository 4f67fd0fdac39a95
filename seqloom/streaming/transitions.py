"""Transition counts over a stream of finished sequences. An extension: the batch operators have no streaming counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.graph import transitions


def stream_counts(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """Running ``src, dst, cnt`` for update or complete mode; the state holds one number an edge."""
    return transitions(seqs, seq)


def append_shards(seqs: DataFrame, seq: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's counts as a shard of its own below ``path``; sum shards with ``graph.from_shards``.

    A batch that is repeated after a failure overwrites its own shard, so counts stay exact.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        transitions(batch, seq).withColumn("shard", F.lit(epoch).cast("int")).write.mode("overwrite").parquet(f"{path}/shard={epoch}")

    return seqs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
