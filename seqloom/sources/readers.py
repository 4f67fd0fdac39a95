"""Raw logs and catalogues, with explicit schemas and an ``ord`` column where file order matters: (file, place of its block, row).

Codecs follow from the file's suffix. Malformed rows are dropped or become null as each docstring says; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.operators.sequences import pair_first_row, pair_min_ts


def _ord() -> Column:
    """A row's place in the order of files, blocks and rows; to be selected together with columns of the file source itself."""
    return F.struct(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i")).alias("ord")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, ord``: lines with an order that follows file, place in the file and line."""
    return spark.read.text(path).select("value", _ord())


def body(spark: SparkSession, path: str) -> DataFrame:
    """``value, ord`` of the lines after the first of each file."""
    raw = lines(spark, path)
    heads = raw.groupBy(F.col("ord._f").alias("_file")).agg(F.min("ord").alias("_h"))  # a row per file
    return raw.join(heads, F.col("ord._f") == F.col("_file")).filter(F.col("ord") != F.col("_h")).select("value", "ord")


def fields(df: DataFrame, sep: str, least: int, names: Sequence[str], strip: bool = True) -> DataFrame:
    """Separated lines of at least ``least`` fields; the first fields get ``names``. No quoting."""
    v = tx_strip(F.col("value")) if strip else F.col("value")
    cut_ = F.split(v, _quote(sep))
    return df.withColumn("_c", cut_).filter(F.size("_c") >= least).select(*[F.get("_c", i).alias(n) for i, n in enumerate(names)], "ord")


def _quote(sep: str) -> str:
    return "".join("\\" + c if c in r".|^$*+?()[]{}\\" else c for c in sep)


def tx_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"[\r\n]+$", "")


def tagged_events(spark: SparkSession, path: str, packed: bool) -> DataFrame:
    """Tag events with a header: ``user, item, tag, ts, ord``.

    ``packed``: nine columns with the date in parts, the time is a packed number and 0 if malformed, and empty tags are null.
    Otherwise four columns with milliseconds, and rows with a malformed time are dropped.
    """
    raw = body(spark, path)
    if packed:
        cols = ["user", "item", "tag", "day", "month", "year", "hour", "minute", "second"]
        f = fields(raw, "\t", 6, cols)
        ts = tx.packed_timestamp(*[F.col(c) for c in ("year", "month", "day", "hour", "minute", "second")])
        return f.select("user", "item", F.when(F.col("tag") != "", F.col("tag")).alias("tag"), ts.alias("ts"), "ord")
    f = fields(raw, "\t", 4, ["user", "item", "tag", "ms"])
    return f.select("user", "item", "tag", F.expr("try_cast(ms AS bigint)").alias("ts"), "ord").filter("ts IS NOT NULL")


def first_tagging(events: DataFrame) -> DataFrame:
    """``user, item, ts, ord`` of each pair's first row in file order."""
    return pair_first_row(events, "user", "item", ["ord"]).select("user", "item", "ts", "ord")


def earliest_tagging(events: DataFrame) -> DataFrame:
    """``user, item, ts, first`` with each pair's least time."""
    return pair_min_ts(events, "user", "item", "ts", "ord")


def key_columns(spark: SparkSession, path: str, key: int, values: Sequence[int]) -> DataFrame:
    """``key, v0, v1, ...`` of a tab-separated file with a header; short rows are dropped, the last row of a key wins."""
    n = max([key, *values]) + 1
    f = fields(body(spark, path), "\t", n, [f"c{i}" for i in range(n)])
    last = f.groupBy(F.col(f"c{key}").alias("key")).agg(F.max_by(F.struct(*[F.col(f"c{v}").alias(f"v{i}") for i, v in enumerate(values)]), "ord").alias("_v"))
    return last.select("key", "_v.*")


def double_colon(spark: SparkSession, path: str, names: Sequence[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """``::``-separated lines in Latin-1; rows with too few fields are dropped."""
    raw = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").schema("value string").csv(path)
    return fields(raw.select("value", _ord()), "::", len(names), names, strip=False)


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """``user, item, rating, ts, ord``; rows with a malformed number are dropped."""
    r = double_colon(spark, path, ["user", "item", "rating", "ts"])
    return r.select("user", "item", F.expr("try_cast(rating AS int)").alias("rating"), F.expr("try_cast(ts AS bigint)").alias("ts"), "ord").filter("rating IS NOT NULL AND ts IS NOT NULL")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, plus ``ord``; malformed lines become nulls."""
    return lines(spark, path).select(F.from_json("value", schema).alias("o"), "ord").select("o.*", "ord")


def object_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON or Python literals, one a line, plus ``ord``; other lines are dropped."""
    rows = lines(spark, path).select(tx.object_lines(F.col("value")).alias("j"), "ord").filter("j IS NOT NULL")
    return rows.select(F.from_json("j", schema).alias("o"), "ord").select("o.*", "ord")


def object_map(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """``key, value`` of a whole-file JSON object."""
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"map<string,{value_type}>").alias("m"))
    return rows.select(F.explode("m").alias("key", "value"))


def csv_columns(spark: SparkSession, path: str, columns: Sequence[str], blanks: bool = True, line_breaks: bool = True) -> DataFrame:
    """Named columns of a CSV with a header, all as strings, plus ``ord``; with ``blanks`` empty fields are empty strings instead of nulls.

    Only without ``line_breaks`` within fields can a file be split among tasks.
    """
    df = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path).select(*columns, _ord())
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns], "ord") if blanks else df


def quoted_tsv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Tab-separated, quoted, no header; ``names`` are given to the first columns, plus ``ord``."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.option("sep", "\t").option("quote", '"').option("escape", '"').schema(schema).csv(path).select(*[f"`{n}`" for n in names], _ord())
