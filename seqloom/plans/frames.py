"""The two interaction logs that the driver's tables hold, and their sequences: E (events) and L (orders and their lines)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.sequences import build_sequences, long_enough
from seqloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def catalogue() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """Queries and their SQL by name, and the decorator that enters a query with its SQL (None if SQL can't say it)."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(text: str | None) -> Callable:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query


L_ORDER = ["o_orderdate", "o_orderkey", "l_linenumber"]


def events_log(spark: SparkSession, d: str) -> DataFrame:
    """``user_id, item, ts, ord, event_type``; the item is the number in ``props``."""
    e = table(spark, d, "events")
    return e.select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item"), "ts", F.col("event_id").alias("ord"), "event_type").filter(F.col("user_id").isNotNull() & F.col("item").isNotNull())


def lines_log(spark: SparkSession, d: str) -> DataFrame:
    """``user_id, item, supplier`` and the ordering columns of each order line."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("supplier"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), "o_orderdate")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("user_id", "item", "supplier", *L_ORDER)


def event_sequences(spark: SparkSession, d: str) -> DataFrame:
    """``user_id, seq`` of users with at least 3 events."""
    return long_enough(build_sequences(events_log(spark, d), "user_id", "item", ["ts", "ord"]), "seq")


def line_sequences(spark: SparkSession, d: str) -> DataFrame:
    return long_enough(build_sequences(lines_log(spark, d), "user_id", "item", L_ORDER), "seq")


E = """e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, ts, event_id AS ord, event_type FROM events),
es AS (SELECT user_id, list(item ORDER BY ts, ord) AS seq FROM e GROUP BY user_id HAVING count(*) >= 3)"""
L = """l AS (
  SELECT o_custkey AS user_id, l_partkey AS item, l_suppkey AS supplier, o_orderdate, o_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ls AS (SELECT user_id, list(item ORDER BY o_orderdate, o_orderkey, l_linenumber, item) AS seq FROM l GROUP BY user_id HAVING count(*) >= 3)"""


def exploded(source: str, seq: str = "seq") -> str:
    """SQL of the long form of a list column."""
    return f"SELECT user_id, unnest(range(1, len({seq}) + 1)) AS pos, unnest({seq}) AS item_id FROM {source}"
