"""Queries of the training-data problems, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.cooccurrence import pair_lift
from seqloom.llm.encoding_repair import repair_texts
from seqloom.llm.lookalike import look_classes, same_look, visible_forms
from seqloom.llm.neighbours import nearest_neighbours
from seqloom.llm.packing import CAPACITY, pack
from seqloom.llm.paths import frequent_paths
from seqloom.llm.similar_pairs import similar_pairs
from seqloom.llm.tokenization import token_counts, token_ids
from seqloom.llm.toxicity import toxicity
from seqloom.runtime import table


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar other items of every item with a usable vector."""
    return nearest_neighbours(table(spark, d, "t5xl"), "item_id", "embedding").withColumn("cosine", F.round(F.col("cosine").cast("double"), 4))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items whose vectors have a cosine of at least 0.90."""
    return similar_pairs(table(spark, d, "t5xl"), "item_id", "embedding", 0.9)


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Item orders of 3 or 4 items with the users behind each."""
    rows = frequent_paths(table(spark, d, "testing"), "user_id", "sequence_data")
    return rows.select(F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("item_path"), F.size("path").alias("n_items"), "n_users", "support")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_paths(spark, d).select("item_path")


def p5_pair_lift(spark: SparkSession, d: str) -> DataFrame:
    """All item pairs of at least 6 users with lift and conviction."""
    rows = pair_lift(table(spark, d, "testing"), "user_id", "sequence_data", min_users=6)
    return rows.withColumns({"lift": _rounded("lift"), "conviction": _rounded("conviction")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Item pairs of at least 6 users and a lift of at least 15."""
    return pair_lift(table(spark, d, "testing"), "user_id", "sequence_data", min_users=6, min_lift=15).select("item_a", "item_b")


def p6_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Garbled items with the restored text, and whether all of it could be restored."""
    return repair_texts(table(spark, d, "items"), "id", "text").filter("garbled").select("id", "restored", "whole")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Items whose text was decoded with a wrong encoding somewhere."""
    return repair_texts(table(spark, d, "items"), "id", "text").filter("garbled AND id IS NOT NULL").select("id").distinct()


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct item row with the one consistent form of its text."""
    return visible_forms(table(spark, d, "items").select("id", "text").distinct(), "text").select("id", "form")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Items whose texts look the same but are stored differently."""
    return same_look(table(spark, d, "items"), "id", "text")


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """Items that look like others but are stored differently, with their class and the number of such others."""
    return look_classes(table(spark, d, "items"), "id", "text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of each document."""
    return token_ids(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or of each part of one over the capacity."""
    return pack(token_counts(table(spark, d, "documents")))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by fill: one row with the number of containers, their tokens and the share of unused space."""
    used = p9_containers(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("t")).filter("t > 0")
    return used.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("t").alias("n_tokens"),
        F.max("t").alias("fullest"),
        F.round(1 - F.sum("t") / (F.count(F.lit(1)) * CAPACITY), 6).alias("unused_share"),
    )


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score, verdict and the strongest passage of each document."""
    return toxicity(table(spark, d, "documents"), table(spark, d, "labels")).withColumn("score", F.round("score", 4))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least one abusive, hateful or sexual passage."""
    return toxicity(table(spark, d, "documents"), table(spark, d, "labels")).filter("toxic AND doc_id IS NOT NULL").select("doc_id").distinct()


def p10_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, toxic documents and their share per source; documents without a source are a group of their own."""
    rows = toxicity(table(spark, d, "documents"), table(spark, d, "labels"))
    n = F.sum(F.col("toxic").cast("bigint"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), n.alias("n_toxic"), F.round(n / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("score"), 4).alias("mean_score"))


def _rounded(x: str) -> Column:
    return F.floor(F.col(x) * 1e6 + 0.5001) / 1e6


QUERIES = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p5_found": p5_found,
    "p5_pair_lift": p5_pair_lift,
    "p6_found": p6_found,
    "p6_repairs": p6_repairs,
    "p7_found": p7_found,
    "p7_classes": p7_classes,
    "p7_forms": p7_forms,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_source_rates": p10_source_rates,
}

_P3 = """n AS (SELECT count(DISTINCT user_id) AS n FROM testing),
least AS (SELECT greatest(5, ceil(n * 0.01)) AS m FROM n),
r AS (SELECT DISTINCT user_id, sequence_data FROM testing WHERE user_id IS NOT NULL),
e0 AS (SELECT user_id AS u, unnest(sequence_data) AS i, unnest(range(len(sequence_data))) AS p FROM r),
often AS (SELECT i FROM e0 WHERE i IS NOT NULL GROUP BY i HAVING count(DISTINCT u) >= (SELECT m FROM least)),
e AS (SELECT e0.* FROM e0 JOIN often USING (i)),
l1 AS (SELECT u, i AS a, min(p) AS p FROM e GROUP BY ALL),
l2 AS (SELECT l1.u, a, e.i AS b, min(e.p) AS p FROM l1 JOIN e ON l1.u = e.u AND e.p > l1.p AND e.i <> a GROUP BY ALL),
f2 AS (SELECT a, b FROM l2 GROUP BY ALL HAVING count(DISTINCT u) >= (SELECT m FROM least)),
l2f AS (SELECT l2.* FROM l2 JOIN f2 USING (a, b)),
l3 AS (SELECT x.u, a, b, e.i AS c, min(e.p) AS p FROM l2f x JOIN e ON x.u = e.u AND e.p > x.p AND e.i NOT IN (a, b) GROUP BY ALL),
f3 AS (SELECT a, b, c, count(DISTINCT u) AS n_users FROM l3 GROUP BY ALL HAVING count(DISTINCT u) >= (SELECT m FROM least)),
l3f AS (SELECT l3.* FROM l3 JOIN f3 USING (a, b, c)),
l4 AS (SELECT x.u, a, b, c, e.i AS d FROM l3f x JOIN e ON x.u = e.u AND e.p > x.p AND e.i NOT IN (a, b, c) GROUP BY ALL),
f4 AS (SELECT a, b, c, d, count(DISTINCT u) AS n_users FROM l4 GROUP BY ALL HAVING count(DISTINCT u) >= (SELECT m FROM least)),
p3 AS (
  SELECT concat_ws('>', a, b, c) AS item_path, 3 AS n_items, n_users FROM f3
  UNION ALL SELECT concat_ws('>', a, b, c, d), 4, n_users FROM f4)"""
_P5 = """n AS (SELECT count(DISTINCT user_id) AS n FROM testing),
e AS (SELECT DISTINCT user_id AS u, unnest(sequence_data) AS i FROM testing WHERE user_id IS NOT NULL),
k AS (SELECT i, count(*) AS n FROM e WHERE i IS NOT NULL GROUP BY i),
pair AS (SELECT x.i AS item_a, y.i AS item_b, count(*) AS n_ab FROM e x JOIN e y ON x.u = y.u AND x.i < y.i GROUP BY ALL HAVING count(*) >= 6),
p5 AS (
  SELECT item_a, item_b, n_ab, ka.n AS n_a, kb.n AS n_b, n.n AS n_users, n_ab * n.n / (ka.n * kb.n) AS lift,
    CASE WHEN n_ab < ka.n THEN (1 - kb.n / n.n) / (1 - n_ab / ka.n) END AS conviction
  FROM pair JOIN k ka ON ka.i = item_a JOIN k kb ON kb.i = item_b, n)"""

_P1 = """u AS (
  SELECT item_id, min(embedding) AS e FROM t5xl
  WHERE item_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY item_id)"""

SQL = {
    "p1_found": f"""WITH {_P1}
SELECT a.item_id AS item_a, b.item_id AS item_b FROM u a JOIN u b ON a.item_id < b.item_id
WHERE list_cosine_similarity(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) >= 0.9""",
    "p3_found": f"WITH {_P3} SELECT item_path FROM p3",
    "p3_paths": f"WITH {_P3} SELECT item_path, n_items, n_users, round(n_users / (SELECT n FROM n), 6) AS support FROM p3",
    "p5_found": f"WITH {_P5} SELECT item_a, item_b FROM p5 WHERE n_ab * n_users >= 15 * n_a * n_b",
    "p5_pair_lift": f"WITH {_P5} SELECT * REPLACE (floor(lift * 1e6 + 0.5001) / 1e6 AS lift, floor(conviction * 1e6 + 0.5001) / 1e6 AS conviction) FROM p5",
}
