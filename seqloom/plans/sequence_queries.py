"""Queries of the sequence, filter, text and statistics operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.operators import filters, metrics, sequences as sq
from seqloom.operators.sinks import shard_numbers
from seqloom.plans.frames import E, L, L_ORDER, catalogue, event_sequences, events_log, exploded, line_sequences, lines_log
from seqloom.runtime import table

QUERIES, SQL, query = catalogue()


def _long(df: DataFrame, seq: str = "seq") -> DataFrame:
    return sq.positions(df, "user_id", seq)


def _mapped(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return _long(df.withColumn("seq", f(F.col("seq"))))


# -- sequences -------------------------------------------------------------------------------------------


@query(f"WITH {E} {exploded('es')}")
def seq_build(spark: SparkSession, d: str) -> DataFrame:
    return _long(event_sequences(spark, d))


@query(f"WITH {L} {exploded('ls')}")
def seq_build_baskets(spark: SparkSession, d: str) -> DataFrame:
    return _long(line_sequences(spark, d))


@query(f"""WITH {E}, x AS ({exploded('es')}),
y AS (SELECT *, lag(item_id) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM x)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS pos, item_id FROM y WHERE p IS DISTINCT FROM item_id""")
def seq_dedup_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(event_sequences(spark, d), sq.dedup_consecutive)


@query(f"""WITH {E}, x AS ({exploded('es')}), y AS (SELECT user_id, item_id, min(pos) AS p FROM x GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY p) AS pos, item_id FROM y""")
def seq_distinct_first(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(event_sequences(spark, d), sq.distinct_first)


@query(f"""WITH {L}, t AS (SELECT user_id, seq[greatest(len(seq) - 19, 1):] AS seq FROM ls) {exploded('t')}""")
def seq_truncate_recent(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most recent items, cut from whole sequences."""
    return _mapped(line_sequences(spark, d), lambda s: sq.recent(s, 20))


@query(f"""WITH {L}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o_orderdate DESC, o_orderkey DESC, l_linenumber DESC, item DESC) AS r FROM l),
t AS (SELECT user_id, list(item ORDER BY r DESC) AS seq FROM r WHERE r <= 20 GROUP BY user_id) {exploded('t')}""")
def seq_build_recent(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most recent items, without ever gathering a whole user."""
    return _long(sq.build_recent(lines_log(spark, d), "user_id", "item", L_ORDER, 20))


@query(f"WITH {E}, t AS (SELECT user_id, list_append(seq[1:len(seq) - 1], seq[len(seq)]) AS seq FROM es) {exploded('t')}")
def seq_append_next(spark: SparkSession, d: str) -> DataFrame:
    s = event_sequences(spark, d).select("user_id", sq.all_but(F.col("seq"), 1).alias("prev"), F.element_at("seq", -1).alias("next"))
    return _long(s.select("user_id", sq.append_next(F.col("prev"), F.col("next")).alias("seq")))


@query(f"WITH {L}, t AS (SELECT user_id, seq[1:len(seq) - 2] AS seq FROM ls) {exploded('t')}")
def split_train(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(line_sequences(spark, d), lambda s: sq.all_but(s, 2))


@query(f"WITH {L}, t AS (SELECT user_id, seq[1:len(seq) - 1] AS seq FROM ls) {exploded('t')}")
def split_eval(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(line_sequences(spark, d), lambda s: sq.all_but(s, 1))


@query(f"WITH {L} {exploded('ls')}")
def split_test(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(line_sequences(spark, d), lambda s: sq.all_but(s, 0))


@query(f"""WITH {L} SELECT user_id, seq[-1] AS target, seq[-2] AS last, seq[-3] AS before_last, len(seq) - 1 AS n_history FROM ls""")
def test_targets(spark: SparkSession, d: str) -> DataFrame:
    t = sq.targets(line_sequences(spark, d), "user_id", "seq")
    return t.select("user_id", "target", "last", "before_last", F.size("history").cast("bigint").alias("n_history"))


test_targets.__test__ = False  # not a test


@query(f"""WITH {E} SELECT user_id, item, ord FROM e QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY ord) = 1""")
def pair_first_row(spark: SparkSession, d: str) -> DataFrame:
    return sq.pair_first_row(events_log(spark, d), "user_id", "item", ["ord"]).select("user_id", "item", "ord")


@query(f"""WITH {E} SELECT user_id, item, min(ts) AS ts, min(ord) AS first FROM e GROUP BY ALL""")
def pair_min_ts(spark: SparkSession, d: str) -> DataFrame:
    return sq.pair_min_ts(events_log(spark, d), "user_id", "item", "ts", "ord")


@query(f"""WITH {L}, k AS (SELECT DISTINCT CAST(item AS VARCHAR) AS item_key FROM l) SELECT item_key, row_number() OVER (ORDER BY item_key) - 1 AS item_id FROM k""")
def item_ids_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Keys sort as strings, so 10 comes before 2."""
    return sq.dense_ids(lines_log(spark, d).select(F.col("item").cast("string").alias("item_key")), "item_key", "item_id")


@query(f"""WITH {L}, x AS ({exploded('ls')}), f AS (SELECT item_id, min((user_id, pos)) AS f FROM x GROUP BY item_id)
SELECT item_id, row_number() OVER (ORDER BY f) - 1 AS dense_id FROM f""")
def item_ids_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return sq.first_seen_ids(line_sequences(spark, d), "user_id", "seq")


@query(f"""WITH {L} SELECT user_id AS user_key, row_number() OVER (ORDER BY user_id) - 1 AS user_id FROM (SELECT DISTINCT user_id FROM ls)""")
def user_ids_dense(spark: SparkSession, d: str) -> DataFrame:
    return sq.dense_ids(line_sequences(spark, d).select(F.col("user_id").alias("user_key")), "user_key", "user_id")


@query(f"""WITH {E}, v AS (SELECT user_id, ts, ord, item, date_trunc('day', ts) AS day FROM e WHERE event_type = 'view'),
h AS (SELECT user_id, day AS ts, min(ord) AS ord, list(item ORDER BY ts, ord) AS items FROM v GROUP BY user_id, day),
hl AS (SELECT user_id, items FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, ord) = 1),
c AS (SELECT user_id, list(item ORDER BY ts, ord) AS items FROM e WHERE event_type = 'purchase' GROUP BY user_id),
b AS (SELECT coalesce(hl.user_id, c.user_id) AS user_id, list_concat(coalesce(hl.items, []), coalesce(c.items, [])) AS seq FROM hl FULL JOIN c ON hl.user_id = c.user_id),
x AS ({exploded('b')}), y AS (SELECT user_id, item_id, min(pos) AS p FROM x GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY p) AS pos, item_id FROM y""")
def history_plus_clicks(spark: SparkSession, d: str) -> DataFrame:
    """A day's views are a history, purchases are clicks."""
    log = events_log(spark, d)
    views = log.filter(F.col("event_type") == "view").withColumn("day", F.date_trunc("day", "ts"))
    rows = views.groupBy("user_id", "day").agg(F.min("ord").alias("o"), F.array_sort(F.collect_list(F.struct("ts", "ord", "item"))).alias("s"))
    hist = rows.select("user_id", F.col("day").alias("ts"), F.col("o").alias("ord"), F.col("s.item").alias("items"))
    return _long(sq.history_plus_clicks(hist, log.filter(F.col("event_type") == "purchase"), "user_id"))


# -- filters ---------------------------------------------------------------------------------------------

_PAIRS = f"{L}, p0 AS (SELECT DISTINCT user_id, item FROM l)"


def _round(k: int, users: int = 22, items: int = 20) -> str:
    return f"""a{k} AS (SELECT * FROM p{k - 1} WHERE item IN (SELECT item FROM p{k - 1} GROUP BY item HAVING count(*) >= {users})),
p{k} AS (SELECT * FROM a{k} WHERE user_id IN (SELECT user_id FROM a{k} GROUP BY user_id HAVING count(*) >= {items}))"""


def _line_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lines_log(spark, d).select("user_id", "item").distinct()


@query(f"""WITH {L}, x AS ({exploded('ls')}), o AS (SELECT item_id FROM x GROUP BY item_id HAVING count(*) >= 30),
k AS (SELECT * FROM x WHERE item_id IN (SELECT item_id FROM o)),
c AS (SELECT *, lag(item_id) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM k),
f AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM c WHERE p IS DISTINCT FROM item_id)
SELECT user_id, pos, item_id FROM f WHERE n >= 30""")
def kcore_one_pass(spark: SparkSession, d: str) -> DataFrame:
    return _long(filters.kcore_one_pass(line_sequences(spark, d), "user_id", "seq", k=30))


@query(f"WITH {_PAIRS}, {_round(1)} SELECT user_id, item FROM p1")
def kcore_bipartite_once(spark: SparkSession, d: str) -> DataFrame:
    return filters.bipartite_kcore(_line_pairs(spark, d), "user_id", "item", 22, 20)


@query(f"WITH {_PAIRS}, {', '.join(_round(k) for k in range(1, 11))} SELECT user_id, item FROM p10")
def kcore_bipartite_iterative(spark: SparkSession, d: str) -> DataFrame:
    return filters.bipartite_kcore(_line_pairs(spark, d), "user_id", "item", 22, 20, iterative=True)


@query(f"""WITH {L} SELECT user_id, item, o_orderkey, l_linenumber FROM l
WHERE user_id IN (SELECT user_id FROM l GROUP BY user_id HAVING count(*) >= 30) AND item IN (SELECT item FROM l GROUP BY item HAVING count(*) >= 30)""")
def kcore_original_counts(spark: SparkSession, d: str) -> DataFrame:
    return filters.original_counts_kcore(lines_log(spark, d), "user_id", "item", 30, 30).select("user_id", "item", "o_orderkey", "l_linenumber")


@query(f"""WITH {L} SELECT user_id, item, o_orderkey, l_linenumber FROM l WHERE item IN (SELECT item FROM l GROUP BY item HAVING count(*) >= 30)""")
def kcore_item_only(spark: SparkSession, d: str) -> DataFrame:
    return filters.item_threshold(lines_log(spark, d), "item", 30).select("user_id", "item", "o_orderkey", "l_linenumber")


def _tags(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers tag parts with the nation of the supplier."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("tag"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("tag"), F.col("n_name").alias("name"))
    return lines_log(spark, d).join(s, "supplier").select("user_id", "item", "tag"), names


_TAGS = f"""{L}, t AS (SELECT l.user_id, l.item, s_nationkey AS tag FROM l JOIN supplier ON s_suppkey = supplier),
v AS (SELECT n_nationkey AS tag, trim(n_name) AS name FROM nation WHERE length(trim(n_name)) BETWEEN 1 AND 40 AND regexp_matches(n_name, '\\p{{L}}')
  AND n_nationkey IN (SELECT tag FROM t GROUP BY tag HAVING count(DISTINCT user_id) >= 5))"""


@query(f"WITH {_TAGS} SELECT tag, name FROM v")
def tag_valid(spark: SparkSession, d: str) -> DataFrame:
    t, names = _tags(spark, d)
    return filters.valid_tags(t, names, "user_id", "tag", "name")


@query(f"""WITH {_TAGS}, c AS (SELECT item, tag, count(*) AS n FROM t GROUP BY ALL)
SELECT item, row_number() OVER (PARTITION BY item ORDER BY n DESC, CAST(tag AS VARCHAR)) AS rank, name FROM c JOIN v USING (tag)
QUALIFY rank <= 5""")
def tag_top_names(spark: SparkSession, d: str) -> DataFrame:
    t, names = _tags(spark, d)
    return filters.top_tags(t, filters.valid_tags(t, names, "user_id", "tag", "name"), "item", "tag", "name")


# -- text ------------------------------------------------------------------------------------------------

_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]"


def _sql_clean(c: str) -> str:
    marks = " || ".join(f"chr({ord(x)})" for x in tx.LINE_MARKS)
    return f"regexp_replace(translate(coalesce({c}, ''), {marks}, '{' ' * len(tx.LINE_MARKS)}'), '^{_BLANK}+|{_BLANK}+$', '', 'g')"


@query(f"SELECT doc_id, {_sql_clean('text')} AS text FROM documents")
def text_clean_ws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clean_ws(F.col("text")).alias("text"))


@query(None)
def text_clean_ascii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clean_ascii(F.col("text")).alias("text"))


@query(f"""SELECT id, locale, regexp_replace(strip_accents({_sql_clean('brand')}), '[^\\x00-\\x7f]', '', 'g') AS brand FROM (SELECT DISTINCT id, locale, brand FROM products_train)""")
def text_clean_ascii_brands(spark: SparkSession, d: str) -> DataFrame:
    """Brands hold accents but no compatibility signs, for which SQL has no decomposition."""
    p = table(spark, d, "products_train").select("id", "locale", "brand").distinct()
    return p.select("id", "locale", tx.clean_ascii(F.col("brand")).alias("brand"))


@query(f"""WITH c AS (SELECT id, {', '.join(f'{_sql_clean(x)} AS {x}' for x in ('title', 'brand', 'color', 'material', 'descr'))} FROM (SELECT DISTINCT * FROM products_train))
SELECT id, concat_ws('; ', {', '.join(f"CASE WHEN {c} <> '' THEN '{n}: ' || {c} END" for n, c in (('Title', 'title'), ('Brand', 'brand'), ('Color', 'color'), ('Material', 'material'), ('Description', 'descr')))}) AS text FROM c""")
def text_item_fields(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products_train").distinct()
    fields = [("Title", "title"), ("Brand", "brand"), ("Color", "color"), ("Material", "material"), ("Description", "descr")]
    return p.select("id", tx.join_fields([(n, F.col(c)) for n, c in fields]).alias("text"))


@query(r"""WITH t AS (SELECT session_id, prev_items, list_filter(regexp_split_to_array(regexp_replace(coalesce(prev_items, ''), '[\[\]\n'']', ' ', 'g'), '\s+'), lambda x: x <> '') AS a FROM sessions_train)
SELECT session_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS item FROM t""")
def text_bracket_list(spark: SparkSession, d: str) -> DataFrame:
    """The plain reading of lists; ``p4_found`` reads all ways of writing them."""
    s = table(spark, d, "sessions_train").select("session_id", F.posexplode(tx.bracket_list(F.col("prev_items"))).alias("p", "item"))
    return s.select("session_id", (F.col("p") + 1).cast("bigint").alias("pos"), "item")


@query(f"""WITH {E}, s AS (SELECT user_id, string_agg(event_type || '-' || item || '-' || CASE WHEN event_type = 'purchase' THEN '1' ELSE '0' END, ' ' ORDER BY ord) AS imp FROM e GROUP BY user_id),
t AS (SELECT user_id, unnest(string_split(imp, ' ')) AS tok FROM s)
SELECT user_id, regexp_extract(tok, '^(.*)-([^-]*)$', 1) AS clicked, count(*) AS n FROM t WHERE regexp_extract(tok, '^(.*)-([^-]*)$', 2) = '1' GROUP BY ALL""")
def text_impressions(spark: SparkSession, d: str) -> DataFrame:
    tok = F.concat_ws("-", "event_type", F.col("item").cast("string"), F.when(F.col("event_type") == "purchase", "1").otherwise("0"))
    s = events_log(spark, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", tok.alias("t")))), lambda x: x["t"]), " ").alias("imp"))
    x = s.select("user_id", F.explode(tx.impressions(F.col("imp"))).alias("x")).filter("x.label = '1'")
    return x.groupBy("user_id", F.col("x.id").alias("clicked")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, date_trunc('second', o_orderdate) AS t_long, date_trunc('second', o_orderdate) AS t_us, date_trunc('day', o_orderdate) AS t_iso FROM orders""")
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    """Three formats, written from the order's date and read back."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    long_ = F.concat(F.lit("Mon "), F.date_format("t", "MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("t", "yyyy"))
    return o.select(
        "o_orderkey",
        tx.parse_long_date(long_).alias("t_long"),
        tx.parse_us_date(F.date_format("t", "M/d/yyyy h:mm:ss a")).alias("t_us"),
        tx.parse_iso_date(F.date_format("t", "y-M-d")).alias("t_iso"),
    )


@query("""SELECT event_id, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS packed, CAST(0 AS BIGINT) AS malformed FROM events""")
def packed_timestamp(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    parts = [f(F.col("ts")).cast("string") for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)]
    return e.select("event_id", tx.packed_timestamp(*parts).alias("packed"), tx.packed_timestamp(*parts[:-1], F.lit("x")).alias("malformed"))


# -- statistics and sharding -----------------------------------------------------------------------------

_STATS = """s AS (SELECT (SELECT count(*) FROM ls) AS n_users, (SELECT count(*) FROM part) AS n_items, (SELECT CAST(sum(len(seq)) AS BIGINT) FROM ls) AS n_interactions)"""


@query(f"WITH {L}, {_STATS} SELECT n_users, n_items, n_interactions, round(n_interactions / n_users, 6) AS avg_len FROM s")
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dataset_stats(line_sequences(spark, d), "seq", table(spark, d, "part")).withColumn("avg_len", F.round("avg_len", 6))


@query(f"""WITH {L}, {_STATS}
SELECT 'n_users' AS name, 1500.0 AS expected, CAST(n_users AS DOUBLE) AS found, CASE WHEN n_users = 1500 THEN 'OK' ELSE 'MISMATCH' END AS status FROM s
UNION ALL SELECT 'n_items', 2000.0, n_items, CASE WHEN n_items = 2000 THEN 'OK' ELSE 'MISMATCH' END FROM s
UNION ALL SELECT 'avg_len', 40.0, round(n_interactions / n_users, 6), CASE WHEN abs(n_interactions / n_users - 40.0) <= 0.01 THEN 'OK' ELSE 'MISMATCH' END FROM s""")
def dataset_verify(spark: SparkSession, d: str) -> DataFrame:
    stats = metrics.dataset_stats(line_sequences(spark, d), "seq", table(spark, d, "part"))
    return metrics.verify(stats, {"n_users": 1500, "n_items": 2000, "avg_len": 40.0}).withColumn("found", F.round("found", 6))


@query(f"""WITH {L}, i AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS id FROM ls), n AS (SELECT count(*) AS n FROM i)
SELECT user_id, id, CAST(floor(id / ceil(n / 32)) AS BIGINT) AS shard FROM i, n""")
def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    ids = sq.dense_ids(line_sequences(spark, d).select("user_id"), "user_id", "id")
    return shard_numbers(ids, "id", 32)


@query("""WITH r AS (SELECT DISTINCT user_id, book_id, date_added, rating, loaded_at FROM interactions WHERE book_id IS NOT NULL AND user_id IS NOT NULL AND coalesce(rating, 0) >= 4),
s AS (SELECT user_id, list(book_id ORDER BY date_added, loaded_at, book_id) AS seq FROM r GROUP BY user_id HAVING count(*) >= 3)
SELECT user_id, unnest(range(1, len(seq) + 1)) AS pos, unnest(seq) AS item_id FROM s""")
def domain_rated_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of well rated books from the raw log: distinct rows, rating of 4 or more, ordered by time, at least 3 long."""
    i = table(spark, d, "interactions").select("user_id", "book_id", "date_added", "rating", "loaded_at").distinct()
    i = i.filter(F.col("book_id").isNotNull() & F.col("user_id").isNotNull() & (F.coalesce("rating", F.lit(0)) >= 4))
    return _long(sq.long_enough(sq.build_sequences(i, "user_id", "book_id", ["date_added", "loaded_at"]), "seq"))


@query("""WITH r AS (SELECT DISTINCT user_id, sequence_data FROM testing WHERE user_id IS NOT NULL AND len(sequence_data) >= 3)
SELECT count(*) AS n_users, (SELECT count(DISTINCT id) FROM items) AS n_items, CAST(sum(len(sequence_data)) AS BIGINT) AS n_interactions, round(sum(len(sequence_data)) / count(*), 6) AS avg_len FROM r""")
def domain_stats(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "testing").select("user_id", F.col("sequence_data").alias("seq")).filter(F.col("user_id").isNotNull()).distinct()
    items = table(spark, d, "items").select("id").filter("id IS NOT NULL").distinct()
    return metrics.dataset_stats(sq.long_enough(s, "seq"), "seq", items).withColumn("avg_len", F.round("avg_len", 6))
