"""Queries of sources, sinks and preparation plans: the driver's tables are written in the raw format, read back, and compared with SQL on the tables."""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.operators import embed, graph, sinks
from seqloom.operators.sequences import positions
from seqloom.plans import prepare
from seqloom.plans import recommend as rec
from seqloom.plans.frames import E, L, catalogue, event_sequences, events_log, exploded, line_sequences, lines_log
from seqloom.runtime import shared_dir, table
from seqloom.sources import readers as rd
from seqloom.sources import tfrecord

QUERIES, SQL, query = catalogue()


# -- writing raw files -----------------------------------------------------------------------------------


def _place(spark: SparkSession) -> str:
    """A fresh folder in the shared one, which goes with the session."""
    at = f"{shared_dir(spark).rstrip('/')}/exchange-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def _put(df: DataFrame, fmt: str, **options: str | bool) -> str:
    at = _place(df.sparkSession)
    df.write.format(fmt).options(**options).save(at)
    return at


def _tsv(df: DataFrame) -> str:
    return _put(df, "csv", sep="\t", header=True)


def _quoted(df: DataFrame, sep: str, header: bool) -> str:
    return _put(df, "csv", sep=sep, header=header, escape='"', emptyValue="")


def _sorted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines in the order of time, as a log has them."""
    return lines_log(spark, d).orderBy("o_orderdate", "o_orderkey", "l_linenumber", "item")


def _seconds() -> Column:
    """Seconds since 1970, whatever the session's time zone."""
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)")


def _literal(fields: list[tuple[str, Column]]) -> Column:
    """A line with a Python literal; values come written out."""
    parts = [F.concat(F.lit(f"'{n}': "), v) for n, v in fields]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value")


def _word(c: Column) -> Column:
    """A string as a Python literal."""
    one = tx.list_literal(F.array(c.cast("string")))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def _seqs(prepared: tuple[DataFrame, DataFrame]) -> DataFrame:
    return positions(prepared[0], "user_key", "seq", "item_key")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))


_BY = "o_orderdate, o_orderkey, l_linenumber, item"


def _long(cte: str, seq: str = "seq") -> str:
    return f"SELECT user_key, unnest(range(1, len({seq}) + 1)) AS pos, CAST(unnest({seq}) AS VARCHAR) AS item_key FROM {cte}"


def _user_lists(rows: str, least: int = 3, by: str = _BY, cut: str = "") -> str:
    """``s`` (user_key, seq) of the rows of a table expression, at least ``least`` items each."""
    return f"s0 AS (SELECT CAST(user_id AS VARCHAR) AS user_key, list(item ORDER BY {by}){cut} AS seq FROM {rows} GROUP BY user_id), s AS (SELECT * FROM s0 WHERE len(seq) >= {least})"


# -- readers ---------------------------------------------------------------------------------------------


def _tag_rows(spark: SparkSession, d: str, packed: bool) -> str:
    """Every seventh line of an order has a malformed date, and the tag of every tenth supplier is missing."""
    log = _sorted_lines(spark, d)
    tag = F.when(F.col("supplier") % 10 == 0, F.lit(None)).otherwise(F.col("supplier") % 25).cast("string")
    t, bad = F.col("o_orderdate"), F.col("l_linenumber") == 7
    if packed:
        parts = [F.when(bad, "x").otherwise(F.dayofmonth(t).cast("string")).alias("day"), *[f(t).alias(n) for n, f in (("month", F.month), ("year", F.year), ("hour", F.hour), ("minute", F.minute), ("second", F.second))]]
    else:
        parts = [F.when(bad, "x").otherwise((_seconds() * 1000).cast("string")).alias("ms")]
    return _tsv(log.select(F.col("user_id").alias("user"), "item", tag.alias("tag"), *parts))


_TAG = "CASE WHEN supplier % 10 = 0 THEN NULL ELSE CAST(supplier % 25 AS VARCHAR) END"


@query(f"""WITH {L} SELECT CAST(user_id AS VARCHAR) AS user_name, CAST(item AS VARCHAR) AS item_name, {_TAG} AS tag,
CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(strftime(o_orderdate, '%Y%m%d%H%M%S') AS BIGINT) END AS ts FROM l""")
def read_tags_packed(spark: SparkSession, d: str) -> DataFrame:
    e = rd.tagged_events(spark, _tag_rows(spark, d, True), packed=True)
    return e.select(F.col("user").alias("user_name"), F.col("item").alias("item_name"), "tag", "ts")


@query(f"WITH {L} SELECT CAST(user_id AS VARCHAR) AS user_name, CAST(item AS VARCHAR) AS item_name, epoch_ms(o_orderdate) AS ts FROM l WHERE l_linenumber <> 7")
def read_tags_ms(spark: SparkSession, d: str) -> DataFrame:
    e = rd.tagged_events(spark, _tag_rows(spark, d, False), packed=False)
    return e.select(F.col("user").alias("user_name"), F.col("item").alias("item_name"), "ts")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' b' ELSE s_name END AS name FROM supplier")
def read_key_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every third key has a second row, which wins."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("x").alias("x"), F.col("s_name").alias("name"))
    rows = s.withColumn("n", F.lit(0)).unionByName(s.filter("id % 3 = 0").withColumn("name", F.concat("name", F.lit(" b"))).withColumn("n", F.lit(1)))
    return rd.key_columns(spark, _tsv(rows.orderBy("n", "id").drop("n")), 0, [2]).select("key", F.col("v0").alias("name"))


@query(f"""WITH {L} SELECT CAST(user_id AS VARCHAR) AS user_name, 'é' || item AS item_name, l_linenumber AS rating, CAST(epoch(o_orderdate) AS BIGINT) AS ts
FROM l WHERE l_linenumber <> 3""")
def read_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Latin-1 with double colons; every third line number is malformed."""
    rating = F.when(F.col("l_linenumber") == 3, "x").otherwise(F.col("l_linenumber").cast("string"))
    value = F.concat_ws("::", "user_id", F.concat(F.lit("é"), "item"), rating, _seconds())
    r = rd.ratings(spark, _put(lines_log(spark, d).select(value.alias("value")), "csv", encoding="ISO-8859-1"))
    return r.select(F.col("user").alias("user_name"), F.col("item").alias("item_name"), "rating", "ts")


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def read_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Gzip, one object a line."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))
    return rd.json_lines(spark, _put(c, "json", compression="gzip"), "c_custkey bigint, c_name string, c_acctbal double").drop("ord")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' it''s "new"' AS name, p_partkey % 2 = 0 AS even FROM part WHERE p_partkey % 11 <> 5""")
def read_object_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON, Python literals and Python literals with JSON constants in turn; every eleventh line is broken."""
    name = F.concat("p_name", F.lit(" it's \"new\""))
    even = F.col("p_partkey") % 2 == 0
    p = table(spark, d, "part").withColumn("name", name)
    json_ = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), "name", even.alias("even")))
    lines = [_literal([("id", _word(F.col("p_partkey"))), ("name", _word(F.col("name"))), ("even", F.when(even, yes).otherwise(no))]) for yes, no in (("True", "False"), ("true", "false"))]
    value = F.when(F.col("p_partkey") % 11 == 5, F.lit("{'id': ")).when(F.col("p_partkey") % 3 == 0, json_).when(F.col("p_partkey") % 3 == 1, lines[0]).otherwise(lines[1])
    return rd.object_lines(spark, _put(p.select(value.alias("value")), "text"), "id string, name string, even boolean").drop("ord")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def read_json_object(spark: SparkSession, d: str) -> DataFrame:
    """One object for the file; nations are few."""
    n = table(spark, d, "nation").select(F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("title"))).alias("x"))
    one = n.agg(F.to_json(F.map_from_entries(F.collect_list("x"))).alias("value"))
    return rd.object_map(spark, _put(one, "text"), "struct<title:string>").select("key", F.col("value.title").alias("name"))


_ODD = """'a "' || p_name || '", b' || chr(10) || 'c'"""


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS id, {_ODD} AS p_name, CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS p_size FROM part")
def read_csv_columns(spark: SparkSession, d: str) -> DataFrame:
    """Quotes, commas and line breaks in fields, empty fields, and a column that isn't read."""
    p = _names(spark, d).select("p_type", "id", F.concat(F.lit('a "'), "p_name", F.lit('", b\nc')).alias("p_name"), F.when(F.col("p_size").cast("int") % 2 == 0, F.lit(None)).otherwise(F.col("p_size")).alias("p_size"))
    return rd.csv_columns(spark, _quoted(p, ",", True), ["id", "p_name", "p_size"]).drop("ord")


@query("""SELECT 'N' || p_partkey AS id, p_name || ' "x"' AS title FROM part""")
def read_quoted_tsv(spark: SparkSession, d: str) -> DataFrame:
    p = _names(spark, d).select(F.concat(F.lit("N"), "id").alias("id"), "p_brand", "p_type", F.concat("p_name", F.lit(' "x"')).alias("title"), "p_size")
    return rd.quoted_tsv(spark, _quoted(p, "\t", False), ["id", "b", "c", "title"]).select("id", "title")


@query(f"WITH {E} {exploded('es')}")
def tfrecord_sequences(spark: SparkSession, d: str) -> DataFrame:
    tfrecord.register(spark)
    at = _place(spark)
    event_sequences(spark, d).select("user_id", F.col("seq").alias("sequence_data")).write.format("tfrecord").mode("append").save(at)
    return positions(spark.read.format("tfrecord").load(at), "user_id", "sequence_data")


@query("SELECT p_partkey AS id, p_name || ' é' AS text FROM part")
def tfrecord_items(spark: SparkSession, d: str) -> DataFrame:
    tfrecord.register(spark)
    at = _place(spark)
    table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" é")).alias("text")).write.format("tfrecord").mode("append").save(at)
    return spark.read.format("tfrecord").schema("id bigint, text string").option("verify", "true").load(at)


# -- sinks -----------------------------------------------------------------------------------------------

_IDS = """k AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS item_key, p_name AS text FROM part),
ids AS (SELECT item_key, text, row_number() OVER (ORDER BY item_key) - 1 AS item_id FROM k),
us AS (SELECT user_id AS user_key, row_number() OVER (ORDER BY user_id) - 1 AS user_id FROM ls)"""


def _dataset(spark: SparkSession, d: str, **options) -> str:
    at = _place(spark)
    seqs = line_sequences(spark, d).select(F.col("user_id").alias("user_key"), F.transform("seq", lambda x: x.cast("string")).alias("seq"))
    sinks.write_dataset(at, seqs, _names(spark, d).select(F.col("id").alias("item_key"), F.col("p_name").alias("text")), **options)
    return at


def _split_sql(cut: int, more: str = "") -> str:
    return f"""WITH {L}, {_IDS}, x AS ({exploded('ls')}), n AS (SELECT user_id, len(seq) - {cut} AS n FROM ls)
SELECT us.user_id, x.pos, ids.item_id{more} FROM x JOIN n USING (user_id) JOIN us ON us.user_key = x.user_id JOIN ids ON ids.item_key = CAST(x.item_id AS VARCHAR) WHERE x.pos <= n.n"""


@query(_split_sql(2))
def sink_training_split(spark: SparkSession, d: str) -> DataFrame:
    return positions(spark.read.parquet(f"{_dataset(spark, d)}/training"), "user_id", "sequence_data")


@query(_split_sql(1))
def sink_evaluation_split_tfrecord(spark: SparkSession, d: str) -> DataFrame:
    at = _dataset(spark, d, fmt="tfrecord")
    return positions(spark.read.format("tfrecord").load(f"{at}/evaluation"), "user_id", "sequence_data")


@query(_split_sql(0, ", ids.text"))
def sink_testing_split_with_text(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{_dataset(spark, d, with_text=True)}/testing")
    both = rows.select("user_id", F.posexplode(F.arrays_zip("sequence_data", "text")).alias("p", "x"))
    return both.select("user_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.col("x.sequence_data").alias("item_id"), "x.text")


@query(f"WITH {L}, {_IDS} SELECT item_id, text FROM ids")
def sink_items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{_dataset(spark, d)}/items")


@query(f"WITH {L}, {_IDS} SELECT user_key, user_id FROM us")
def sink_user_ids(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{_dataset(spark, d)}/user_ids").select("user_key", "user_id")


@query("SELECT vec_id AS item_id, len(min(embedding)) AS n, round(list_sum(CAST(min(embedding) AS DOUBLE[])), 6) AS s FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id")
def sink_embeddings(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark)
    sinks.write_embeddings(table(spark, d, "embeddings"), "vec_id", "embedding", at)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(at).select("item_id", F.size("embedding").cast("bigint").alias("n"), F.round(total, 6).alias("s"))


@query(f"""WITH {E}, pr AS (SELECT unnest(list_zip(seq[1:len(seq) - 3], seq[2:len(seq) - 2])) AS p FROM es) SELECT p[1] AS src, p[2] AS dst, count(*) AS cnt FROM pr GROUP BY ALL""")
def sink_graph(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark)
    sinks.write_graph(graph.transitions(event_sequences(spark, d), "seq"), at)
    return spark.read.parquet(at)


@query(f"""WITH {E}, t AS (SELECT user_id, seq[-1] AS target, seq[1:len(seq) - 1][1:10] AS items FROM es)
SELECT user_id, unnest(range(1, len(items) + 1)) AS rank, unnest(items) AS item_id, target FROM t""")
def sink_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Lists cut to ten, with the item held out; here the history stands for a list."""
    at = _place(spark)
    s = event_sequences(spark, d)
    rows = s.select("user_id", F.slice("seq", F.lit(1), F.size("seq") - 1).alias("items"), F.get("seq", F.size("seq") - 1).alias("target"))
    sinks.write_predictions(rows, at)
    back = spark.read.parquet(at)
    assert rec.predictions(rows).columns == back.columns
    return back.select("user_id", F.posexplode("item_ids").alias("p", "item_id"), F.get("gt_ids", 0).alias("target")).select("user_id", (F.col("p") + 1).cast("bigint").alias("rank"), "item_id", "target")


def _letters():
    import numpy as np

    def encode(texts: list[str]):
        width = max([len(t) for t in texts] + [1])
        hidden = np.array([[[float(ord(c)), 1.0] for c in t.ljust(width)] for t in texts])
        return hidden, np.array([[float(i < len(t)) for i in range(width)] for t in texts])

    return encode


@query("""SELECT p_partkey AS item_id, round(list_sum(list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS DOUBLE))) / len(p_name), 3) AS mean_code FROM part""")
def embed_items(spark: SparkSession, d: str) -> DataFrame:
    """The encoder gives each letter its code; pooling takes the mean."""
    v = embed.embed(table(spark, d, "part"), "p_partkey", "p_name", _letters)
    return v.select("item_id", F.round(F.get("embedding", 0).cast("double"), 3).alias("mean_code"))


# -- preparation plans -----------------------------------------------------------------------------------


def _literal_reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = _sorted_lines(spark, d)
    reviews = log.select(_literal([("reviewerID", _word(F.col("user_id"))), ("asin", _word(F.col("item"))), ("ok", F.lit("true")), ("unixReviewTime", _seconds().cast("string"))]))
    p = _names(spark, d).filter("id % 9 <> 0").orderBy(F.col("id").cast("bigint"))
    cats = F.concat(F.lit("["), tx.list_literal(F.array(F.col("p_type"), F.concat("p_type", F.lit("'s")))), F.lit(", ['x']]"))
    brand = F.when(F.col("id") % 2 == 0, _word(F.col("p_brand"))).otherwise(F.lit("None"))
    meta = p.select(_literal([("asin", _word(F.col("id"))), ("title", _word(F.col("p_name"))), ("brand", brand), ("categories", cats)]))
    again = p.select(_literal([("asin", _word(F.col("id"))), ("title", F.lit("'later'"))]))
    return prepare.literal_reviews(spark, _put(reviews, "text", compression="gzip"), _put(meta.withColumn("n", F.lit(0)).unionByName(again.withColumn("n", F.lit(1))).orderBy("n").select("value"), "text", compression="gzip"))


@query(f"WITH {L}, {_user_lists('l')} {_long('s')}")
def pipeline_literal_reviews(spark: SparkSession, d: str) -> DataFrame:
    return _seqs(_literal_reviews(spark, d))


@query(f"""WITH {L} SELECT CAST(p_partkey AS VARCHAR) AS item_key, CASE WHEN p_partkey % 9 = 0 THEN 'ASIN: ' || p_partkey ELSE
'Title: ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '; Brand: ' || p_brand ELSE '' END || '; Categories: [''' || p_type || ''', "' || p_type || '''s"];' END AS text
FROM part WHERE p_partkey IN (SELECT unnest(seq) FROM ls)""")
def pipeline_literal_reviews_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first metadata row of an item wins, and every ninth item has none."""
    return _literal_reviews(spark, d)[1]


def _tag_plan(spark: SparkSession, d: str, packed: bool) -> tuple[DataFrame, DataFrame]:
    log = _sorted_lines(spark, d).select(F.col("user_id").alias("user"), "item", (F.col("supplier") % 25).alias("tag"), "o_orderdate")
    t = F.col("o_orderdate")
    parts = [f(t).alias(n) for n, f in (("day", F.dayofmonth), ("month", F.month), ("year", F.year), ("hour", F.hour), ("minute", F.minute), ("second", F.second))] if packed else [(_seconds() * 1000).alias("ms")]
    titles = _names(spark, d).select("id", F.lit("x").alias("x"), "p_name") if packed else _names(spark, d).select("id", "p_name")
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    plan = prepare.packed_tags if packed else prepare.millisecond_tags
    return plan(spark, _tsv(log.select("user", "item", "tag", *parts)), _tsv(titles), _tsv(names))


_FIRST = f"f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY {_BY}) = 1)"


def _core(k: int, source: str) -> str:
    return f"""c{k}a AS (SELECT * FROM {source} WHERE item IN (SELECT item FROM {source} GROUP BY item HAVING count(DISTINCT user_id) >= 5)),
c{k} AS (SELECT * FROM c{k}a WHERE user_id IN (SELECT user_id FROM c{k}a GROUP BY user_id HAVING count(DISTINCT item) >= 5))"""


_TAG_TEXT = """tv AS (SELECT supplier % 25 AS tag FROM l GROUP BY ALL HAVING count(DISTINCT user_id) >= 5),
tc AS (SELECT item, supplier % 25 AS tag, count(*) AS n FROM l GROUP BY ALL),
tr AS (SELECT item, n_name AS name, row_number() OVER (PARTITION BY item ORDER BY n DESC, CAST(tag AS VARCHAR)) AS r FROM tc JOIN tv USING (tag) JOIN nation ON n_nationkey = tag QUALIFY r <= 5),
tt AS (SELECT item, string_agg(name, ', ' ORDER BY r) AS tags FROM tr GROUP BY item)"""


@query(f"WITH {L}, {_FIRST}, {_core(1, 'f')}, {_user_lists('c1')} {_long('s')}")
def pipeline_packed_tags(spark: SparkSession, d: str) -> DataFrame:
    return _seqs(_tag_plan(spark, d, True))


@query(f"""WITH {L}, {_FIRST}, {_core(1, 'f')}, {_user_lists('c1')}, {_TAG_TEXT}
SELECT CAST(p_partkey AS VARCHAR) AS item_key, 'Title: ' || p_name || coalesce('; Tags: ' || tags, '') AS text FROM part LEFT JOIN tt ON tt.item = p_partkey WHERE p_partkey IN (SELECT unnest(seq) FROM s)""")
def pipeline_packed_tags_texts(spark: SparkSession, d: str) -> DataFrame:
    return _tag_plan(spark, d, True)[1]


@query(f"WITH {L}, {_FIRST}, {', '.join(_core(k, f'c{k - 1}' if k > 1 else 'f') for k in range(1, 9))}, {_user_lists('c8', cut='[-100:]')} {_long('s')}")
def pipeline_millisecond_tags(spark: SparkSession, d: str) -> DataFrame:
    return _seqs(_tag_plan(spark, d, False))


def _rated_movies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = _sorted_lines(spark, d).select(F.concat_ws("::", "user_id", "item", "l_linenumber", _seconds()).alias("value"))
    movies = _names(spark, d).filter("id % 9 <> 0").select(F.concat_ws("::", "id", F.concat("p_name", F.lit(" é")), F.concat_ws("|", "p_type", "p_brand")).alias("value"))
    return prepare.rated_movies(spark, _put(log, "csv", encoding="ISO-8859-1"), _put(movies, "csv", encoding="ISO-8859-1"))


_RATED = "w AS (SELECT * FROM l WHERE item IN (SELECT item FROM l GROUP BY item HAVING count(*) >= 5))"


@query(f"WITH {L}, {_RATED}, {_user_lists('w', cut='[-100:]')} {_long('s')}")
def pipeline_rated_movies(spark: SparkSession, d: str) -> DataFrame:
    return _seqs(_rated_movies(spark, d))


@query(f"""WITH {L}, {_RATED} SELECT CAST(p_partkey AS VARCHAR) AS item_key, CASE WHEN p_partkey % 9 = 0 THEN 'Movie ' || p_partkey ELSE
'Title: ' || p_name || ' e; Genres: ' || p_type || ', ' || p_brand END AS text FROM part WHERE p_partkey IN (SELECT item FROM w)""")
def pipeline_rated_movies_texts(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue holds what was used before the cut to the most recent."""
    return _rated_movies(spark, d)[1]


def _rated_books(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = _sorted_lines(spark, d).join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("item"), (F.col("l_quantity") % 5 + 1).cast("int").alias("rating")).distinct(), ["o_orderkey", "l_linenumber", "item"])
    log = log.orderBy("o_orderdate", "o_orderkey", "l_linenumber", "item", "rating")
    when = F.date_format("o_orderdate", "EEE MMM dd HH:mm:ss Z yyyy")
    rows = log.select(F.col("user_id").cast("string").alias("user_id"), F.col("item").cast("string").alias("book_id"), "rating", F.when(F.col("l_linenumber") == 7, "bad").otherwise(when).alias("date_added"))
    p = _names(spark, d).filter("id % 9 <> 0")
    books = p.select(F.col("id").alias("book_id"), F.col("p_name").alias("title"), F.array(F.struct(F.lit("2").alias("author_id")), F.struct(F.lit("7").alias("author_id")), F.struct(F.lit("1").alias("author_id"))).alias("authors"), F.lit("").alias("publisher"), F.col("p_size").alias("publication_year"))
    old = books.withColumn("title", F.lit("old")).withColumn("n", F.lit(0))
    both = old.unionByName(books.withColumn("n", F.lit(1))).unionByName(books.select("book_id", F.lit(None).cast("string").alias("title"), F.array().cast(books.schema["authors"].dataType).alias("authors"), "publisher", F.lit(None).cast("string").alias("publication_year"), F.lit(2).alias("n")))
    authors = spark.createDataFrame([("1", "Ann", 0), ("2", "Bo", 0), ("1", "Anne", 1), ("2", " ", 2)], "author_id string, name string, n int").orderBy("n").drop("n")
    return prepare.rated_books(spark, _put(rows, "json", compression="gzip"), _put(both.orderBy("n").drop("n"), "json", compression="gzip"), _put(authors, "json", compression="gzip"))


_BOOKS = f"""l0 AS (SELECT o_custkey AS user_id, l_partkey AS item, CAST(l_quantity % 5 AS INT) + 1 AS rating, o_orderdate, o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
l1 AS (SELECT * FROM l0 WHERE rating >= 4 AND item % 9 <> 0 AND l_linenumber <> 7),
b1 AS (SELECT *, lag(item) OVER (PARTITION BY user_id ORDER BY {_BY}, rating) AS p FROM l1), b2 AS (SELECT * FROM b1 WHERE p IS DISTINCT FROM item),
b3 AS (SELECT * EXCLUDE p FROM b2 WHERE item IN (SELECT item FROM b2 GROUP BY item HAVING count(*) >= 5)),
b4 AS (SELECT *, lag(item) OVER (PARTITION BY user_id ORDER BY {_BY}, rating) AS p FROM b3), b5 AS (SELECT * FROM b4 WHERE p IS DISTINCT FROM item),
{_user_lists('b5', 5, _BY + ', rating')}"""


@query(f"WITH {_BOOKS} {_long('s')}")
def pipeline_rated_books(spark: SparkSession, d: str) -> DataFrame:
    """Ratings follow from quantities, every seventh line has a malformed date, every ninth book no text."""
    return _seqs(_rated_books(spark, d))


@query(f"WITH {_BOOKS} SELECT CAST(p_partkey AS VARCHAR) AS item_key, 'Title: ' || p_name || '; Authors: Bo, Anne; Year: ' || p_size AS text FROM part WHERE p_partkey IN (SELECT unnest(seq) FROM s)")
def pipeline_rated_books_texts(spark: SparkSession, d: str) -> DataFrame:
    """Of a book's rows with a text the last wins, and of an author's names the last that isn't empty."""
    return _rated_books(spark, d)[1]


def _game_reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _names(spark, d).filter("id % 9 <> 0")
    games = p.select(_literal([("id", _word(F.col("id"))), ("app_name", _word(F.col("p_name"))), ("developer", _word(F.col("p_brand"))), ("genres", tx.list_literal(F.array(F.col("p_type"), F.lit(""), F.lit("Z"))))]))
    log = _sorted_lines(spark, d)
    day = F.when(F.col("l_linenumber") == 7, "soon").otherwise(F.date_format("o_orderdate", "yyyy-M-d"))
    reviews = log.select(F.to_json(F.struct(F.col("item").cast("string").alias("product_id"), F.col("user_id").cast("string").alias("username"), day.alias("date"))).alias("value"))
    return prepare.game_reviews(spark, _put(games, "text", compression="gzip"), _put(reviews, "text", compression="gzip"))


_GAMES = f"""g0 AS (SELECT * FROM l WHERE item % 9 <> 0 AND l_linenumber <> 7),
g1 AS (SELECT * FROM g0 WHERE user_id IN (SELECT user_id FROM g0 GROUP BY user_id HAVING count(*) >= 5) AND item IN (SELECT item FROM g0 GROUP BY item HAVING count(*) >= 5)),
{_user_lists('g1')}"""


@query(f"WITH {L}, {_GAMES} {_long('s')}")
def pipeline_game_reviews(spark: SparkSession, d: str) -> DataFrame:
    return _seqs(_game_reviews(spark, d))


@query(f"WITH {L}, {_GAMES} SELECT CAST(p_partkey AS VARCHAR) AS item_key, 'Title: ' || p_name || '; Developer: ' || p_brand || '; Genres: ' || p_type || ', Z' AS text FROM part WHERE p_partkey IN (SELECT unnest(seq) FROM s)")
def pipeline_game_reviews_texts(spark: SparkSession, d: str) -> DataFrame:
    return _game_reviews(spark, d)[1]


def _transactions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _names(spark, d)
    blank = F.col("id") % 9 == 0
    cols = {"prod_name": "p_name", "product_type_name": "p_type", "product_group_name": None, "colour_group_name": "p_brand", "department_name": None, "detail_desc": "p_size"}
    articles = p.select(F.col("id").alias("article_id"), *[(F.lit(None).cast("string") if c is None else F.when(~blank, F.col(c))).alias(n) for n, c in cols.items()])
    log = _sorted_lines(spark, d).select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("t_dat"), F.col("user_id").alias("customer_id"), F.col("item").alias("article_id"))
    return prepare.transactions(spark, _quoted(articles, ",", True), _quoted(log, ",", True))


@query(f"""WITH {L}, t0 AS (SELECT *, lag(item) OVER (PARTITION BY user_id ORDER BY {_BY}) AS p FROM l WHERE item % 9 <> 0), t1 AS (SELECT * FROM t0 WHERE p IS DISTINCT FROM item),
{_user_lists('t1')} {_long('s')}""")
def pipeline_transactions(spark: SparkSession, d: str) -> DataFrame:
    return _seqs(_transactions(spark, d))


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_key, 'Title: ' || p_name || '; Type: ' || p_type || '; Color: ' || p_brand || '; Description: ' || p_size AS text FROM part WHERE p_partkey % 9 <> 0")
def pipeline_transactions_texts(spark: SparkSession, d: str) -> DataFrame:
    return _transactions(spark, d)[1]


def _sessions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    products = table(spark, d, "products_train").withColumnRenamed("descr", "desc").orderBy("id", F.desc("title"), F.desc("brand"), "locale", "color", "material", "desc")
    log = table(spark, d, "sessions_train").select("prev_items", "next_item", "locale")
    return prepare.sessions(spark, _quoted(products, ",", True), _quoted(log, ",", True))


_CLEAN = lambda c: f"regexp_replace(replace(coalesce({c}, ''), chr(10), ' '), '^\\s+|\\s+$', '', 'g')"
_PRODUCTS = f"""pu AS (SELECT * FROM products_train WHERE locale = 'UK' AND title IS NOT NULL AND title <> '' AND id IS NOT NULL),
pk AS (SELECT * FROM pu QUALIFY row_number() OVER (PARTITION BY id ORDER BY title DESC NULLS LAST, brand DESC NULLS LAST, color NULLS FIRST, material NULLS FIRST, descr NULLS FIRST) = 1)"""


@query(rf"""WITH {_PRODUCTS},
se AS (SELECT row_number() OVER () AS k, list_filter(regexp_split_to_array(regexp_replace(coalesce(prev_items, ''), '[\[\]\n'']', ' ', 'g'), '\s+'), lambda x: x <> '') AS a, next_item FROM sessions_train WHERE locale = 'UK'),
al AS (SELECT k, CASE WHEN coalesce(next_item, '') = '' THEN a ELSE list_append(a, next_item) END AS s FROM se),
un AS (SELECT k, unnest(s) AS item, unnest(range(len(s))) AS p FROM al),
sq AS (SELECT k, list(item ORDER BY p) AS s FROM un WHERE item IN (SELECT id FROM pk) GROUP BY k)
SELECT array_to_string(s, ' ') AS items, count(*) AS n FROM sq WHERE len(s) >= 3 GROUP BY 1""")
def pipeline_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Lists with the number of sessions that have them, as sessions are numbered by their place in the file."""
    s = _sessions(spark, d)[0]
    return s.groupBy(F.array_join("seq", " ").alias("items")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PRODUCTS} SELECT id AS item_key, array_to_string(list_filter([CASE WHEN {_CLEAN('title')} <> '' THEN 'Title: ' || {_CLEAN('title')} END,
CASE WHEN {_CLEAN('brand')} <> '' THEN 'Brand: ' || {_CLEAN('brand')} END, CASE WHEN {_CLEAN('color')} <> '' THEN 'Color: ' || {_CLEAN('color')} END,
CASE WHEN {_CLEAN('material')} <> '' THEN 'Material: ' || {_CLEAN('material')} END, CASE WHEN {_CLEAN('descr')} <> '' THEN 'Description: ' || {_CLEAN('descr')} END], lambda x: x IS NOT NULL), '; ') AS text FROM pk""")
def pipeline_sessions_texts(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d)[1]


def _news(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ids = spark.range(90).select(F.concat(F.lit("N"), "id").alias("id"), F.lit("c").alias("c"), F.lit("s").alias("s"), F.concat(F.lit('title "'), "id", F.lit('"')).alias("t"))
    late = ids.withColumn("t", F.lit("other")).unionByName(spark.range(90, 95).select(F.concat(F.lit("N"), "id").alias("id"), F.lit("c").alias("c"), F.lit("s").alias("s"), F.lit("late").alias("t")))
    n = lambda k: F.concat(F.lit("N"), ((F.col("item") + k) % 100).cast("string"))
    imps = F.when(F.col("event_type") == "purchase", F.concat_ws(" ", F.concat(n(2), F.lit("-1")), F.concat(n(3), F.lit("-0")))).otherwise(F.lit(""))
    rows = events_log(spark, d).orderBy("ord").select(F.col("ord").cast("string"), F.concat(F.lit("U"), "user_id").alias("u"), F.date_format("ts", "M/d/yyyy h:mm:ss a").alias("t"), F.concat_ws(" ", n(0), n(1)).alias("h"), imps.alias("i"))
    return prepare.news(spark, [_quoted(ids, "\t", False), _quoted(late, "\t", False)], _quoted(rows, "\t", False))


@query(f"""WITH {E}, r AS (SELECT user_id, date_trunc('second', ts) AS t, ord, item, event_type FROM e),
h AS (SELECT user_id, [item, (item + 1) % 100] AS items FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, ord) = 1),
c AS (SELECT user_id, list((item + 2) % 100 ORDER BY t, ord) AS items FROM r WHERE event_type = 'purchase' GROUP BY user_id),
b AS (SELECT h.user_id, list_concat(h.items, coalesce(c.items, [])) AS seq FROM h LEFT JOIN c USING (user_id)),
x AS ({exploded('b')}), y AS (SELECT user_id, item_id, min(pos) AS p FROM x WHERE item_id < 95 GROUP BY ALL),
z AS (SELECT 'U' || user_id AS user_key, list('N' || item_id ORDER BY p) AS seq FROM y GROUP BY user_id HAVING count(*) >= 3) {_long('z')}""")
def pipeline_news(spark: SparkSession, d: str) -> DataFrame:
    return _seqs(_news(spark, d))


@query("""SELECT 'N' || i AS item_key, CASE WHEN i < 90 THEN 'title "' || i || '"' ELSE 'late' END AS text FROM (SELECT unnest(range(95)) AS i)""")
def pipeline_news_texts(spark: SparkSession, d: str) -> DataFrame:
    """The headline of the first file wins."""
    return _news(spark, d)[1]


def _given(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Whole-file objects are small by their nature: nations with the lists of their suppliers."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("k")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("v"))
    users = s.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value"))
    i = table(spark, d, "supplier").filter("s_suppkey % 9 <> 0").select(F.struct(F.col("s_suppkey").cast("string"), F.struct(F.concat("s_name", F.lit(" é")).alias("title"), F.lit("Food").alias("description"))).alias("x"))
    items = i.agg(F.to_json(F.map_from_entries(F.collect_list("x"))).alias("value"))
    return prepare.given_sequences(spark, _put(users, "text"), _put(items, "text"))


_GIVEN = "g AS (SELECT s_nationkey AS user_key, list(s_suppkey ORDER BY s_suppkey) AS seq FROM supplier GROUP BY ALL HAVING count(*) >= 3)"


@query(f"WITH {_GIVEN} SELECT CAST(user_key AS BIGINT) AS user_key, unnest(range(1, len(seq) + 1)) AS pos, unnest(seq) AS item_key FROM g")
def pipeline_given_sequences(spark: SparkSession, d: str) -> DataFrame:
    return _seqs(_given(spark, d))


@query(f"""WITH {_GIVEN} SELECT s_suppkey AS item_key, CASE WHEN s_suppkey % 9 = 0 THEN 'Item: ' || s_suppkey ELSE 'Title: ' || s_name || ' e; Categories: Food' END AS text
FROM supplier WHERE s_suppkey IN (SELECT unnest(seq) FROM g)""")
def pipeline_given_sequences_texts(spark: SparkSession, d: str) -> DataFrame:
    return _given(spark, d)[1]
