"""Queries of the general problems: hot keys (p2) and packed fields (p4), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.packed_fields import split_packed
from seqloom.operators.value_frequency import compress, key_percentiles, key_totals
from seqloom.runtime import cut, table

#: An item is a heavy one from this share on.
HEAVY_SHARE = 0.01
QUANTILES = (0.5, 0.9)


def sequence_elements(spark: SparkSession, d: str) -> DataFrame:
    """``item_id``, ``pos`` of each element of each distinct row of ``testing``; positions count from 1 and include null elements."""
    rows = table(spark, d, "testing").select("user_id", "sequence_data").distinct()
    return rows.select(F.posexplode("sequence_data").alias("p", "item_id")).select("item_id", (F.col("p") + 1).cast("bigint").alias("pos"))


def graph_rows(spark: SparkSession, d: str) -> DataFrame:
    """Distinct rows of ``transition_graph``."""
    return table(spark, d, "transition_graph").select("shard", "src", "dst", "edge_count").distinct()


def _stats(pairs: DataFrame, names: dict[str, str]) -> DataFrame:
    pairs = cut(pairs.filter(F.col("k").isNotNull()))  # one row per key and value; read for the totals, the ranges and the percentiles
    totals = key_totals(pairs)
    pct = key_percentiles(pairs, QUANTILES)
    return totals.join(pct, "k", "left").select(*[F.col(a).alias(b) for a, b in names.items()])


def p2_sequence_item_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per item: elements, distinct positions, most frequent position, median and 90 percent position."""
    pairs = compress(sequence_elements(spark, d), F.col("item_id"), F.col("pos"))
    return _stats(pairs, {"k": "item_id", "n_rows": "n_elements", "n_distinct": "n_positions", "mode": "mode_pos", "p50": "median_pos", "p90": "p90_pos"})


def p2_graph_source_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per ``src``: rows, non-null counts, their sum, distinct counts, mode, median and 90 percent."""
    pairs = compress(graph_rows(spark, d), F.col("src"), F.col("edge_count"))
    return _stats(pairs, {"k": "src", "n_rows": "n_rows", "n_values": "n_counts", "value_sum": "edge_total", "n_distinct": "n_distinct_counts", "mode": "mode_count", "p50": "median_count", "p90": "p90_count"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items on at least one percent of the non-null sequence elements, or ``src`` of one percent of the graph's rows."""

    def heavy(pairs: DataFrame, field: str, nulls_count: bool) -> DataFrame:
        totals = cut(key_totals(pairs))  # one row per key; summed up, then filtered
        whole = totals if nulls_count else totals.filter(F.col("k").isNotNull())
        least = F.lit(HEAVY_SHARE) * whole.agg(F.sum("n_rows")).scalar()
        return totals.filter(F.col("k").isNotNull() & (F.col("n_rows") >= least)).select(F.lit(field).alias("field_name"), F.col("k").alias("item_id"))

    seq = compress(sequence_elements(spark, d), F.col("item_id"), F.col("pos"))
    graph = compress(graph_rows(spark, d), F.col("src"), F.col("edge_count"))
    return heavy(seq, "sequence_data", False).unionByName(heavy(graph, "edge_count", True))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """``session_id``, ``pos``, ``item`` of each value packed in ``prev_items``."""
    return split_packed(table(spark, d, "sessions_train"), ["session_id"], "prev_items")


def p4_item_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Per item: values, sessions and the mean place in its list."""
    rows = p4_found(spark, d)
    per = rows.groupBy("item", "session_id").agg(F.count(F.lit(1)).alias("c"), F.sum("pos").alias("s"))
    return per.groupBy("item").agg(F.sum("c").alias("n_values"), F.count("session_id").alias("n_sessions"), F.round(F.sum("s") / F.sum("c"), 6).alias("mean_pos"))


def p4_learned_splits(spark: SparkSession, d: str) -> DataFrame:
    """Values of letters and digits, packed anew with marks that no list names, and every fifth session's without any mark; split again."""
    rows = p4_found(spark, d).filter(F.col("item").rlike("^[A-Z0-9]+$") & F.col("session_id").isNotNull())
    lists = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("s"))
    mark = F.element_at(F.lit(["", "~", "/", "·", "::"]), (F.pmod("session_id", F.lit(5)) + 1).cast("int"))
    packed = lists.select("session_id", F.array_join(F.col("s.item"), "\u0001").alias("t"), mark.alias("m"))
    return split_packed(packed.select("session_id", F.replace("t", F.lit("\u0001"), F.col("m")).alias("prev_items")), ["session_id"], "prev_items")


QUERIES = {
    "p2_found": p2_found,
    "p2_sequence_item_stats": p2_sequence_item_stats,
    "p2_graph_source_stats": p2_graph_source_stats,
    "p4_found": p4_found,
    "p4_item_sessions": p4_item_sessions,
    "p4_learned_splits": p4_learned_splits,
}

_ELEMENTS = """e AS (
  SELECT unnest(sequence_data) AS item_id, unnest(range(1, len(sequence_data) + 1)) AS pos
  FROM (SELECT DISTINCT user_id, sequence_data FROM testing))"""
_GRAPH = "g AS (SELECT DISTINCT shard, src, dst, edge_count FROM transition_graph)"

_P4 = r"""rows AS (SELECT DISTINCT session_id, prev_items FROM sessions_train WHERE prev_items IS NOT NULL),
toks AS (
  SELECT session_id, prev_items, regexp_extract_all(prev_items,
    '''(?:[^''\\]|\\.|'''')*''|"(?:[^"\\]|\\.|"")*"|‘[^’]*’|“[^”]*”|«[^»]*»|[A-Z0-9]+') AS ts
  FROM rows),
one AS (SELECT session_id, prev_items, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS p FROM toks),
val AS (
  SELECT session_id, prev_items, p, trim(CASE
    WHEN t[1] = '''' THEN replace(replace(t[2:-2], '\''', ''''), '''''', '''')
    WHEN t[1] = '"' THEN replace(replace(t[2:-2], '\"', '"'), '""', '"')
    WHEN t[1] IN ('‘', '“', '«') THEN t[2:-2]
    ELSE t END) AS item
  FROM one),
p4 AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id, prev_items ORDER BY p) AS pos, item
  FROM val WHERE item <> '')"""

SQL = {
    "p2_found": f"""WITH {_ELEMENTS}, {_GRAPH}
SELECT 'sequence_data' AS field_name, item_id FROM e WHERE item_id IS NOT NULL GROUP BY item_id
HAVING count(*) >= 0.01 * (SELECT count(item_id) FROM e)
UNION ALL
SELECT 'edge_count', src FROM g WHERE src IS NOT NULL GROUP BY src HAVING count(*) >= 0.01 * (SELECT count(*) FROM g)""",
    "p2_sequence_item_stats": f"""WITH {_ELEMENTS},
c AS (SELECT item_id, pos, count(*) AS w FROM e WHERE item_id IS NOT NULL GROUP BY ALL)
SELECT s.*, m.mode_pos FROM (
  SELECT item_id, count(*) AS n_elements, count(DISTINCT pos) AS n_positions,
    quantile_disc(pos, 0.5) AS median_pos, quantile_disc(pos, 0.9) AS p90_pos
  FROM e WHERE item_id IS NOT NULL GROUP BY item_id) s
JOIN (SELECT item_id, pos AS mode_pos FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY w DESC, pos) = 1) m USING (item_id)""",
    "p2_graph_source_stats": f"""WITH {_GRAPH},
c AS (SELECT src, edge_count, count(*) AS w FROM g WHERE src IS NOT NULL AND edge_count IS NOT NULL GROUP BY ALL)
SELECT s.*, m.mode_count FROM (
  SELECT src, count(*) AS n_rows, count(edge_count) AS n_counts, CAST(sum(edge_count) AS BIGINT) AS edge_total,
    count(DISTINCT edge_count) AS n_distinct_counts,
    quantile_disc(edge_count, 0.5) AS median_count, quantile_disc(edge_count, 0.9) AS p90_count
  FROM g WHERE src IS NOT NULL GROUP BY src) s
LEFT JOIN (SELECT src, edge_count AS mode_count FROM c QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, edge_count) = 1) m USING (src)""",
    "p4_found": f"WITH {_P4} SELECT session_id, pos, item FROM p4",
    "p4_learned_splits": f"""WITH {_P4}
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos, item) AS pos, item FROM p4
WHERE session_id IS NOT NULL AND regexp_full_match(item, '[A-Z0-9]+')""",
    "p4_item_sessions": f"""WITH {_P4}, per AS (SELECT item, session_id, count(*) AS c, sum(pos) AS s FROM p4 GROUP BY ALL)
SELECT item, CAST(sum(c) AS BIGINT) AS n_values, count(session_id) AS n_sessions, round(sum(s) / sum(c), 6) AS mean_pos FROM per GROUP BY item""",
}
