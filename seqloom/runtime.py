"""Session, table loading and lineage cutting, shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "seqloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):  # one thread a task, as on a cluster
        os.environ.setdefault(name, "1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; only where that setting is unset and all runs in one process (tests,
    the bench on one machine) a temporary folder of this machine is used; elsewhere ``RuntimeError`` is raised.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="seqloom-"))
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Sets the checkpoint folder if no one did, and returns it."""
    at = spark.sparkContext.getCheckpointDir()
    if not at:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
        at = spark.sparkContext.getCheckpointDir()
    return at


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and keeps it in the shared folder, so that lost executors cost no recomputation.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` its files go as soon as nothing refers to it any more. Those of the shuffles
    that led to it go at once, as they are not read again.
    """
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting holds for frames made under it
    finally:
        spark.conf.set(name, before)


def put_shared(spark: SparkSession, data: bytes | Iterable[bytes], suffix: str) -> str:
    """Writes bytes (or pieces of them, one after the other) into the shared folder, and returns the URI. The file goes with the session."""
    uri = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}{suffix}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        step = 1 << 20
        for piece in [data] if isinstance(data, bytes) else data:
            for k in range(0, len(piece), step):
                out.write(bytearray(piece[k : k + step]))
    finally:
        out.close()
    fs.deleteOnExit(path)
    return uri


def exists(spark: SparkSession, path: str, folder: bool = False) -> bool:
    """Whether a file or folder exists on the storage that ``path`` names, whichever it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and (not folder or fs.getFileStatus(p).isDirectory())


def distribute(spark: SparkSession, data: bytes | Iterable[bytes], suffix: str) -> str:
    """Puts bytes into the shared folder and has Spark bring them to each executor; returns the name for ``local_copy``."""
    uri = put_shared(spark, data, suffix)
    spark.sparkContext.addFile(uri)
    return os.path.basename(uri)


def local_copy(name: str) -> str:
    """On an executor: the path of a distributed file."""
    from pyspark import SparkFiles

    return SparkFiles.get(name)


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` bigint keys of which ``repartition(n, key)`` puts exactly one into each partition.

    For few, heavy groups: hashing their natural keys would put some of them into one task by chance.
    """
    from pyspark.sql import functions as F

    found: dict[int, int] = {}
    lo, step = 0, max(64, 16 * n)
    while len(found) < n:
        ids = spark.range(lo, lo + step, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
        for r in ids.groupBy("p").agg(F.min("id").alias("id")).collect():
            found.setdefault(r["p"], r["id"])
        lo += step
    return [found[p] for p in range(n)]
