"""From raw dumps to sequences and item texts: one plan per kind of source.

Each returns ``(seqs, item_text)``: ``user_key, seq`` of users with at least 3 items, and ``item_key, text``. Write them with
``operators.sinks.write_dataset``. Prices and the like are left out of the item texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.operators import filters, sequences as sq
from seqloom.operators import ordering
from seqloom.operators.ordering import first_per_key
from seqloom.sources import readers as rd

Prepared = tuple[DataFrame, DataFrame]
RECENT = 100


def _sequences(log: DataFrame, order: list[str], user: str = "user", item: str = "item") -> DataFrame:
    return sq.build_sequences(log, user, item, order).withColumnRenamed(user, "user_key")


def _texts(used: DataFrame, known: DataFrame, fallback: str) -> DataFrame:
    """``item_key, text`` of the used items; items without a text get ``<fallback> <key>``."""
    return used.join(known, "item_key", "left").select("item_key", F.coalesce(F.when(F.col("text") != "", F.col("text")), F.concat(F.lit(f"{fallback} "), "item_key")).alias("text"))


def _used(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.explode("seq").alias("item_key")).distinct()


def literal_reviews(spark: SparkSession, reviews: str, metadata: str) -> Prepared:
    """Reviews and metadata as Python literals; the first metadata row of an item wins."""
    log = rd.object_lines(spark, reviews, "reviewerID string, asin string, unixReviewTime bigint").filter("reviewerID IS NOT NULL AND asin IS NOT NULL")
    seqs = sq.long_enough(_sequences(log, ["unixReviewTime", "ord"], "reviewerID", "asin"), "seq")
    meta = first_per_key(rd.object_lines(spark, metadata, "asin string, title string, brand string, categories array<array<string>>").filter("asin IS NOT NULL"), ["asin"], ["ord"])
    # Fixed form: the first category path as a list literal, and a closing semicolon, as in the texts that vectors were made of.
    path = F.get("categories", 0)
    fields = tx.join_fields([("Title", F.col("title")), ("Brand", F.col("brand"))])
    cats = F.when(F.size(path) > 0, F.concat(F.lit("Categories: "), tx.list_literal(path)))
    text = F.concat_ws("; ", F.when(fields != "", fields), cats)
    known = meta.select(F.col("asin").alias("item_key"), F.when(text != "", F.concat(text, F.lit(";"))).alias("text"))
    return seqs, _texts(_used(seqs), known, "ASIN:")


def _tag_texts(used: DataFrame, events: DataFrame, names: DataFrame, titles: DataFrame, label: str, fallback: str) -> DataFrame:
    valid = filters.valid_tags(events, names, "user", "tag", "name")
    top = filters.top_tags(events.filter("tag IS NOT NULL"), valid, "item", "tag", "name")
    tags = top.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("_t")).select(F.col("item").alias("item_key"), tx.list_in_order(F.col("_t.name")).alias("tags"))
    rows = used.join(titles, "item_key", "left").join(tags, "item_key", "left")
    return _texts(used, rows.select("item_key", tx.join_fields([(label, F.col("title")), ("Tags", F.col("tags"))]).alias("text")), fallback)


def packed_tags(spark: SparkSession, events: str, items: str, tags: str) -> Prepared:
    """Tag events with packed dates: first row of each pair, one bipartite pass 5/5, order of time."""
    e = rd.tagged_events(spark, events, packed=True)
    pairs = filters.bipartite_kcore(rd.first_tagging(e), "user", "item", 5, 5)
    seqs = sq.long_enough(_sequences(pairs, ["ts", "ord"]), "seq")
    titles = rd.key_columns(spark, items, 0, [2]).select(F.col("key").alias("item_key"), F.col("v0").alias("title"))
    names = rd.key_columns(spark, tags, 0, [1]).select(F.col("key").alias("tag"), F.col("v0").alias("name"))
    return seqs, _tag_texts(_used(seqs), e, names, titles, "Title", "Bookmark")


def millisecond_tags(spark: SparkSession, events: str, items: str, tags: str) -> Prepared:
    """Tag events with milliseconds: earliest time of each pair, bipartite passes 5/5 to the fixed point, the 100 most recent."""
    e = rd.tagged_events(spark, events, packed=False)
    pairs = filters.bipartite_kcore(rd.earliest_tagging(e), "user", "item", 5, 5, iterative=True)
    whole = _sequences(pairs, ["ts", "first"])
    seqs = sq.long_enough(whole.withColumn("seq", sq.recent(F.col("seq"), RECENT)), "seq")
    titles = rd.key_columns(spark, items, 0, [1]).select(F.col("key").alias("item_key"), F.col("v0").alias("title"))
    names = rd.key_columns(spark, tags, 0, [1]).select(F.col("key").alias("tag"), F.col("v0").alias("name"))
    return seqs, _tag_texts(_used(whole), e, names, titles, "Artist", "Artist")


def rated_movies(spark: SparkSession, ratings: str, movies: str) -> Prepared:
    """All ratings count: items with 5 or more, the 100 most recent of each user; the catalogue holds items from before the cut."""
    log = filters.item_threshold(rd.ratings(spark, ratings), "item", 5)
    whole = _sequences(log, ["ts", "ord"])
    seqs = sq.long_enough(whole.withColumn("seq", sq.recent(F.col("seq"), RECENT)), "seq")
    m = rd.double_colon(spark, movies, ["item_key", "title", "genres"])
    known = m.select("item_key", tx.clean_ascii(tx.join_fields([("Title", F.col("title")), ("Genres", tx.list_in_order(F.split("genres", r"\|")))])).alias("text"))
    return seqs, _texts(_used(whole), known, "Movie")


def rated_books(spark: SparkSession, interactions: str, books: str, authors: str, least: int = 4) -> Prepared:
    """Well rated books with a text and a readable date; repeats collapse; one k-core pass. Of a book's usable rows and of an author's names the last wins."""
    a = rd.json_lines(spark, authors, "author_id string, name string").select("author_id", tx.clean_ws(F.col("name")).alias("name"), "ord")
    a = a.filter("author_id IS NOT NULL AND name <> ''").groupBy("author_id").agg(F.max_by("name", "ord").alias("name"))
    b = rd.json_lines(spark, books, "book_id string, title string, authors array<struct<author_id:string>>, publisher string, publication_year string, description string").filter("book_id IS NOT NULL")
    by = b.select("ord", F.posexplode("authors").alias("p", "a")).select("ord", "p", "a.author_id").join(a, "author_id")
    names = by.groupBy("ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "name"))), lambda x: x["name"]), ", ").alias("names"))
    full = b.join(names, "ord", "left")
    text = tx.join_fields([("Title", F.col("title")), ("Authors", F.col("names")), ("Publisher", F.col("publisher")), ("Year", F.col("publication_year")), ("Description", F.col("description"))])
    known = full.select(F.col("book_id").alias("item_key"), text.alias("text"), "ord").filter("text <> ''").groupBy("item_key").agg(F.max_by("text", "ord").alias("text"))
    log = rd.json_lines(spark, interactions, "user_id string, book_id string, rating int, date_added string")
    log = log.filter(F.coalesce("rating", F.lit(0)) >= least).withColumn("ts", tx.parse_long_date(F.col("date_added"))).filter("ts IS NOT NULL AND user_id IS NOT NULL")
    log = log.join(known.select(F.col("item_key").alias("book_id")), "book_id", "left_semi")
    seqs = _sequences(log, ["ts", "ord"], "user_id", "book_id")
    seqs = filters.kcore_one_pass(seqs.withColumn("seq", sq.dedup_consecutive(F.col("seq"))), "user_key", "seq", 5)
    return seqs, _texts(_used(seqs), known, "Book")


def game_reviews(spark: SparkSession, games: str, reviews: str) -> Prepared:
    """Reviews of games with a text, dated; users and items with 5 or more in the log as it is; repeats stay."""
    g = rd.object_lines(spark, games, "id string, app_name string, title string, developer string, publisher string, genres array<string>, tags array<string>, specs array<string>")
    lists = [(n, tx.list_in_order(F.coalesce(c, F.array().cast("array<string>")))) for n, c in (("Genres", F.col("genres")), ("Tags", F.col("tags")), ("Specs", F.col("specs")))]
    name = F.coalesce(F.when(F.col("app_name") != "", F.col("app_name")), F.col("title"))
    known = first_per_key(g.filter("id IS NOT NULL"), ["id"], [F.desc("ord")])
    known = known.select(F.col("id").alias("item_key"), tx.join_fields([("Title", name), ("Developer", F.col("developer")), ("Publisher", F.col("publisher")), *lists]).alias("text")).filter("text <> ''")
    log = rd.object_lines(spark, reviews, "product_id string, username string, date string").withColumn("ts", tx.parse_iso_date(F.col("date")))
    log = log.filter("ts IS NOT NULL AND username IS NOT NULL AND product_id IS NOT NULL").join(known.select(F.col("item_key").alias("product_id")), "product_id", "left_semi")
    log = filters.original_counts_kcore(log, "username", "product_id", 5, 5)
    seqs = sq.long_enough(_sequences(log, ["ts", "ord"], "username", "product_id"), "seq")
    return seqs, _texts(_used(seqs), known, "Game")


def transactions(spark: SparkSession, articles: str, log_path: str) -> Prepared:
    """Transactions by day and file order: items with a text are kept first, repeats collapse after."""
    # Labels of the item text and the columns they come from.
    cols = [("Title", "prod_name"), ("Type", "product_type_name"), ("Group", "product_group_name"), ("Color", "colour_group_name"), ("Department", "department_name"), ("Description", "detail_desc")]
    a = rd.csv_columns(spark, articles, ["article_id", *[c for _, c in cols]])
    known = a.select(F.col("article_id").alias("item_key"), tx.join_fields([(n, F.col(c)) for n, c in cols]).alias("text"), "ord").filter("text <> ''").groupBy("item_key").agg(F.max_by("text", "ord").alias("text"))
    log = rd.csv_columns(spark, log_path, ["t_dat", "customer_id", "article_id"], line_breaks=False)
    log = log.join(known.select(F.col("item_key").alias("article_id")), "article_id", "left_semi")
    seqs = _sequences(log, ["t_dat", "ord"], "customer_id", "article_id")
    return sq.long_enough(seqs.withColumn("seq", sq.dedup_consecutive(F.col("seq"))), "seq"), known


def sessions(spark: SparkSession, products: str, log_path: str, locale: str = "UK") -> Prepared:
    """Sessions stand for users; of a product's titled rows the first wins; repeats stay."""
    # Labels of the item text and the columns they come from.
    cols = [("Title", "title"), ("Brand", "brand"), ("Color", "color"), ("Material", "material"), ("Description", "desc")]
    p = rd.csv_columns(spark, products, ["id", "locale", *[c for _, c in cols]])
    p = first_per_key(p.filter((F.col("locale") == locale) & (F.col("title") != "")), ["id"], ["ord"])
    known = p.select(F.col("id").alias("item_key"), tx.join_fields([(n, F.col(c)) for n, c in cols]).alias("text"))
    # sessions are numbered in the order of the file
    log = ordering.numbered(rd.csv_columns(spark, log_path, ["prev_items", "next_item", "locale"]), ["ord"], "user_key").filter(F.col("locale") == locale)
    seq = sq.append_next(tx.bracket_list(F.col("prev_items")), F.col("next_item"))
    long = log.select("user_key", F.posexplode(seq).alias("pos", "item_key")).join(known.select("item_key"), "item_key", "left_semi")
    seqs = sq.build_sequences(long, "user_key", "item_key", ["pos"])
    return sq.long_enough(seqs, "seq"), known


def news(spark: SparkSession, headlines: list[str], behaviours: str) -> Prepared:
    """Latest history and clicked impressions of each user, each item once; headlines of the first file win. A malformed time is an error."""
    parts = [rd.quoted_tsv(spark, h, ["id", "c1", "c2", "title"]).select("id", "title", F.struct(F.lit(i).alias("f"), "ord").alias("o")) for i, h in enumerate(headlines)]
    titles = parts[0]
    for p in parts[1:]:
        titles = titles.unionByName(p)
    known = first_per_key(titles.filter("title IS NOT NULL AND title <> ''"), ["id"], ["o"]).select(F.col("id").alias("item_key"), F.col("title").alias("text"))
    b = rd.quoted_tsv(spark, behaviours, ["n", "user", "time", "history", "impressions"]).withColumn("ts", tx.parse_us_date(F.col("time"), strict=True)).filter("user IS NOT NULL")
    hist = b.select("user", "ts", "ord", F.filter(F.split(F.coalesce("history", F.lit("")), r"\s+"), lambda x: x != "").alias("items"))
    clicks = b.select("user", "ts", "ord", F.posexplode(tx.impressions(F.col("impressions"))).alias("p", "x")).filter("x.label = '1'")
    clicks = clicks.select("user", "ts", F.struct("ord", "p").alias("ord"), F.col("x.id").alias("item"))
    whole = sq.history_plus_clicks(hist, clicks, "user").withColumnRenamed("user", "user_key")
    long = whole.select("user_key", F.posexplode("seq").alias("pos", "item_key")).join(known.select("item_key"), "item_key", "left_semi")
    return sq.long_enough(sq.build_sequences(long, "user_key", "item_key", ["pos"]), "seq"), known


def given_sequences(spark: SparkSession, users: str, items: str) -> Prepared:
    """Sequences and items as whole-file JSON objects."""
    seqs = rd.object_map(spark, users, "array<bigint>").select(F.col("key").cast("bigint").alias("user_key"), F.col("value").alias("seq"))
    i = rd.object_map(spark, items, "struct<title:string,description:string>")
    fields: list[tuple[str, Column]] = [("Title", F.col("value.title")), ("Categories", F.col("value.description"))]
    known = i.select(F.col("key").cast("bigint").alias("item_key"), tx.clean_ascii(tx.join_fields(fields)).alias("text"))
    seqs = sq.long_enough(seqs, "seq")
    return seqs, _texts(_used(seqs), known, "Item:")


PLANS: dict[str, Callable[..., Prepared]] = {
    "cds": literal_reviews,
    "delicious": packed_tags,
    "lastfm": millisecond_tags,
    "ml-1m": rated_movies,
    "goodreads-comics": rated_books,
    "goodreads-children": rated_books,
    "steam": game_reviews,
    "hm": transactions,
    "amazon-m2-uk": sessions,
    "mind": news,
    "yelp": given_sequences,
}
