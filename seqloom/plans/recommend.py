"""Recommendation from one or two source items: rings, scores, grouped top-k, fold and padding composed into one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators import assembly, graph, ordering, ranking
from seqloom.operators.sequences import targets
from seqloom.operators.vectors import anchors_mean, normalise
from seqloom.runtime import cut


@dataclass(frozen=True)
class Config:
    """Both methods. The defaults."""

    budgets: tuple[int, ...] = (7, 2, 1)
    budgets2: tuple[int, ...] = (5, 1)
    budgets3: tuple[int, ...] = (3, 1)
    alpha: float = 0.5
    last_n: int = 1
    max_hops: int = 2
    explicit_depth: int = 0  # rings that are expanded; the next one is everything outside of them and of the history. 0 = all
    top_k: int = 10
    seed: int = 42
    semantic_pad: bool = False

    def depth(self, *budgets: tuple[int, ...]) -> int:
        """Rings that are expanded."""
        d = max(self.max_hops, *map(len, budgets))
        return min(d, self.explicit_depth) if self.explicit_depth else d


def unit_vectors(rows: DataFrame, item: str, vector: str) -> DataFrame:
    """``item, e`` in unit length, the smallest vector of an item that has several; null vectors are left out (they count as zero)."""
    return rows.filter(F.col(item).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(item).alias("item")).agg(normalise(F.min(vector)).alias("e"))


def n_items_of(edges: DataFrame, seqs: DataFrame, seq: str) -> int:
    """1 + the largest id in edges, histories and targets."""
    a = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    b = seqs.agg(F.max(F.array_max(seq))).first()[0]
    return 1 + max(-1 if a is None else a, -1 if b is None else b)


def _ranked(edges: DataFrame, sources: DataFrame, vectors: DataFrame, depth: int, alpha: float, k: int) -> tuple[DataFrame, DataFrame]:
    """Ring picks per source, scored against the source's own vector: the work is done once per distinct source, not per user."""
    ring, visited = graph.rings(edges, sources, depth)
    anchors = sources.join(vectors, sources["src"] == vectors["item"]).select(F.col("src").alias("q"), normalise(F.col("e"), 1e-8).alias("anchor"))
    cands = ring.select(F.col("src").alias("q"), "src", "hop", "item")
    return ranking.top_per_ring(ranking.score(cands, anchors, vectors, graph.edge_weights(edges), alpha), k), visited


#: Bytes that the pairs of a round may take: sources are taken in as many rounds as their second ring asks for.
ROUND_BYTES = 1 << 30


def _two_rings(lists: DataFrame, sources: DataFrame, vectors: DataFrame, alpha: float, k: int) -> DataFrame:
    """As ``_ranked`` with two rings, without listing all pairs.

    A source without a vector has a cosine of 0 to everything, so the k smallest ids are the best of its second ring, and of the others no row is
    made. Sources are taken in rounds of which only the k best of each ring are kept, so the space on disk doesn't grow with the pairs.
    """
    first = vectors.select(F.size("e").alias("d")).first()
    each = 1 + (first["d"] if first else 0)
    roots = cut(sources.join(vectors.select(F.col("item").alias("src"), F.lit(True).alias("hot")), "src", "left").select("src", F.coalesce("hot", F.lit(False)).alias("hot")))
    out_of = lists.groupBy(F.col("src").alias("dst")).agg(F.sum(F.size("dsts")).alias("n"))
    into = graph.unpacked(lists.join(roots, "src")).groupBy("dst").agg(F.sum(F.when(F.col("hot"), each).otherwise(1)).alias("s"))
    cells = into.join(out_of, "dst").agg(F.sum(F.col("s") * F.col("n"))).first()[0] or 0
    rounds, done = max(1, -(-8 * cells // ROUND_BYTES)), None
    for r in range(rounds):
        part = roots.filter(F.pmod(F.xxhash64("src"), F.lit(rounds)) == r)
        own = lists.join(part, "src")
        near = graph.unpacked(own)
        far = graph.reached_twice(lists, own, part, k)
        w = graph.edge_weights(near.filter("NOT hot").drop("hot"))
        plain = w.select(F.col("src").alias("q"), "src", F.lit(1).alias("hop"), F.col("dst").alias("item"), (F.round(alpha * F.col("w"), ranking.DIGITS) if alpha > 0 else F.lit(0.0)).alias("score"))
        plain = plain.unionByName(far.filter("NOT hot").select(F.col("src").alias("q"), "src", F.lit(2).alias("hop"), "item", F.lit(0.0).alias("score")))
        cands = near.filter("hot").select(F.col("src").alias("q"), "src", F.lit(1).alias("hop"), F.col("dst").alias("item"))
        cands = cands.unionByName(far.filter("hot").select(F.col("src").alias("q"), "src", F.lit(2).alias("hop"), "item"))
        anchors = part.filter("hot").join(vectors, F.col("src") == vectors["item"]).select(F.col("src").alias("q"), normalise(F.col("e"), 1e-8).alias("anchor"))
        scored = ranking.score(cands, anchors, vectors, graph.edge_weights(near.filter("hot").drop("hot")), alpha)
        best = cut(ranking.top_per_ring(plain.unionByName(scored), k))
        done = best if done is None else done.unionByName(best)
    return done


def _none() -> Column:
    return F.array().cast("array<bigint>")


class _Pads:
    """What lists are topped up with: the best outside of rings and history, then pseudo-random vertices, numbered once for all lists."""

    def __init__(self, edges: DataFrame, vectors: DataFrame, cfg: Config, n_items: int):
        self.edges, self.vectors, self.cfg, self.n_items, self._pool = edges, vectors, cfg, n_items, None

    def outside(self, users: DataFrame, visited: DataFrame, k: int, anchors: DataFrame | None = None, masked: DataFrame | None = None) -> DataFrame:
        """``user_id, outside``: the k ids closest to a user's anchor that are neither visited from ``src``, nor in ``history``, nor ``masked`` (user_id, item).

        ``users``: ``user_id, src, history``. Without ``anchors`` the source's own vector is the anchor: then one ranking per source is
        made, longer by the most ids that any user masks, and each user passes over their own.
        """
        own = users.select("user_id", F.explode("history").alias("item"))
        own = cut((own if masked is None else own.unionByName(masked.select("user_id", "item"))).distinct())
        if anchors is None:
            most = own.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
            q = users.select("src").distinct().join(self.vectors.select(F.col("item").alias("src"), "e"), "src", "left").select(F.col("src").alias("q"), normalise(F.col("e"), 1e-8).alias("anchor"))
            top = ranking.complement_top(q, visited.select(F.col("src").alias("q"), "item"), self.vectors, self.n_items, k + most)
            rows = users.select("user_id", "src").join(top.select(F.col("q").alias("src"), "item", "score"), "src").join(own, ["user_id", "item"], "left_anti")
            top = ordering.top_per_key(rows, ["user_id"], [F.desc("score"), "item"], k)
        else:
            q = users.join(anchors, "user_id", "left").select(F.col("user_id").alias("q"), "anchor")
            gone = own.unionByName(users.select("user_id", "src").join(visited, "src").select("user_id", "item")).select(F.col("user_id").alias("q"), "item")
            top = ranking.complement_top(q, gone, self.vectors, self.n_items, k).withColumnRenamed("q", "user_id")
        return top.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("_o")).select("user_id", F.col("_o.item").alias("outside"))

    def random(self, rows: DataFrame, total: int, already: str | None = None) -> DataFrame:
        """Lists shorter than ``total`` are topped up. The lists are kept, as they are read again; without short ones they are done."""
        cols = rows.columns
        rows = cut(rows)
        short = rows.filter(F.size("items") < total)
        if short.isEmpty():
            return rows
        if self._pool is None:
            self._pool = assembly.pad_pool(graph.vertices(self.edges))
        pool, n = self._pool
        if n == 0:
            return rows
        pad = assembly.random_pad(short.select(F.col("user_id").alias("q"), "items", *([already] if already else [])), pool, n, total, self.cfg.seed, "items", already=already)
        out = rows.join(pad.withColumnRenamed("q", "user_id"), "user_id", "left")
        return out.withColumn("items", F.concat("items", F.coalesce("pad", _none()))).select(*cols)


def _with_outside(rows: DataFrame, outside: DataFrame, explicit: int, budgets: tuple[int, ...]) -> DataFrame:
    """Puts the outside picks in the place of the first ring that isn't expanded. Those after it would hold the same, and take what it leaves over."""
    none = F.array_repeat(_none(), len(budgets))
    picks = F.concat(F.slice(F.coalesce("picks", none), 1, explicit), F.array(F.coalesce("outside", _none())), F.array_repeat(_none(), len(budgets) - explicit - 1))
    return rows.join(outside, "user_id", "left").withColumn("picks", picks).drop("outside")


def single_source(seqs: DataFrame, edges: DataFrame, vectors: DataFrame, cfg: Config = Config(), n_items: int | None = None) -> DataFrame:
    """``user_id, items, target``: rings around the last history item, scored against the mean of the last ``last_n`` history items.

    ``seqs``: ``user_id, seq`` with at least 3 items each; ``edges``: ``src, dst, cnt``; ``vectors``: ``item, e``. A list holds the sum
    of the budgets, or fewer items where the graph has fewer. History is not excluded from rings. With ``explicit_depth``, the ring after
    it holds everything outside of the expanded rings and of the history. ``n_items``: ids run below it; by default 1 + the largest id.
    """
    total, depth = sum(cfg.budgets), cfg.depth(cfg.budgets)
    t = targets(seqs, "user_id", "seq").filter(F.col("last").isNotNull())
    sources = t.select(F.col("last").alias("src")).distinct()
    deep = len(cfg.budgets) > depth
    lists = None
    if depth == 2 and cfg.last_n == 1 and not deep and not cfg.semantic_pad and {dict(edges.dtypes)[c] for c in ("src", "dst", "cnt")} == {"bigint"}:
        lists = graph.packed(edges)
        edges = graph.unpacked(lists)
        if not lists.filter(F.col("src").isNull() | F.exists("dsts", F.isnull)).isEmpty():
            lists = None
    pads = _Pads(edges, vectors, cfg, (n_items_of(edges, seqs, "seq") if n_items is None else n_items) if deep or cfg.semantic_pad else 0)
    anchors = None
    if cfg.last_n == 1:
        ranked, visited = (_two_rings(lists, sources, vectors, cfg.alpha, total), None) if lists is not None else _ranked(edges, sources, vectors, depth, cfg.alpha, total)
        rows = t.join(assembly.ring_lists(ranked, len(cfg.budgets)).withColumnRenamed("q", "last"), "last", "left")
    else:
        ring, visited = graph.rings(edges, sources, depth)
        anchors = anchors_mean(t, "user_id", "history", vectors, cfg.last_n)
        cands = t.select(F.col("user_id").alias("q"), F.col("last").alias("src")).join(ring, "src").select("q", "src", "hop", "item")
        ranked = ranking.top_per_ring(ranking.score(cands, anchors.withColumnRenamed("user_id", "q"), vectors, graph.edge_weights(edges), cfg.alpha), total)
        rows = t.join(assembly.ring_lists(ranked, len(cfg.budgets)).withColumnRenamed("q", "user_id"), "user_id", "left")
    users = t.select("user_id", F.col("last").alias("src"), "history")
    if deep:
        rows = _with_outside(rows, pads.outside(users, visited, total, anchors), depth, cfg.budgets)
    rows = assembly.assemble(rows, "picks", cfg.budgets).select("user_id", "items", "target")
    if cfg.semantic_pad:
        rows = _semantic(cut(rows), users, visited, total, pads, anchors)
    return pads.random(rows, total)


def _semantic(rows: DataFrame, users: DataFrame, visited: DataFrame, total: int, pads: _Pads, anchors: DataFrame | None = None, already: str | None = None) -> DataFrame:
    """Short lists are topped up with the closest ids outside of everything visited and of the history (and of ``already``)."""
    short = rows.filter(F.size("items") < total)
    masked = short.select("user_id", F.explode(already).alias("item")) if already else None
    got = pads.outside(users.join(short.select("user_id"), "user_id", "left_semi"), visited, total, anchors, masked)
    more = F.coalesce("outside", _none())
    return rows.join(got, "user_id", "left").withColumn("items", assembly.top_up(F.col("items"), more, total, F.col(already) if already else None)).drop("outside")


def two_source(seqs: DataFrame, edges: DataFrame, vectors: DataFrame, cfg: Config = Config(), n_items: int | None = None) -> DataFrame:
    """``user_id, items, target``: picks around the last history item, then around the one before, masked by the first.

    The first list is padded before the second source runs. The second source keeps its budget plus the number of first picks per source
    and ring, so that masking per user stays exact. Catch-all rings and semantic padding as in ``single_source``, for each source by its own.
    """
    first, second = sum(cfg.budgets2), sum(cfg.budgets3)
    depth = cfg.depth(cfg.budgets2, cfg.budgets3)
    t = targets(seqs, "user_id", "seq").filter(F.col("last").isNotNull())
    outside = max(len(cfg.budgets2), len(cfg.budgets3)) > depth or cfg.semantic_pad
    pads = _Pads(edges, vectors, cfg, (n_items_of(edges, seqs, "seq") if n_items is None else n_items) if outside else 0)
    users2 = t.select("user_id", F.col("last").alias("src"), "history")
    ranked2, visited2 = _ranked(edges, users2.select("src").distinct(), vectors, depth, cfg.alpha, first)
    a = t.join(assembly.ring_lists(ranked2, len(cfg.budgets2)).withColumnRenamed("q", "last"), "last", "left")
    if len(cfg.budgets2) > depth:
        a = _with_outside(a, pads.outside(users2, visited2, first), depth, cfg.budgets2)
    a = assembly.assemble(a, "picks", cfg.budgets2).select("user_id", "items", "target", "before_last")
    if cfg.semantic_pad:
        a = _semantic(cut(a), users2, visited2, first, pads)
    a = pads.random(a, first)

    users3 = t.filter(F.col("before_last").isNotNull()).select("user_id", F.col("before_last").alias("src"), "history")
    ranked3, visited3 = _ranked(edges, users3.select("src").distinct(), vectors, depth, cfg.alpha, first + second)
    per_user = a.select(F.col("user_id"), F.col("before_last").alias("src")).join(ranked3.select(F.col("q").alias("src3"), "hop", "item", "score"), F.col("src") == F.col("src3"))
    per_user = per_user.select(F.col("user_id").alias("q"), F.col("hop"), F.col("item"), F.col("score"), F.lit(0).alias("rank"))
    taken = a.select(F.col("user_id").alias("q"), F.explode("items").alias("item"))
    masked = ranking.without(per_user, taken, second)
    b = a.withColumnRenamed("items", "first").join(assembly.ring_lists(masked, len(cfg.budgets3)).withColumnRenamed("q", "user_id"), "user_id", "left")
    if len(cfg.budgets3) > depth:
        b = _with_outside(b, pads.outside(users3, visited3, second, masked=taken.withColumnRenamed("q", "user_id")), depth, cfg.budgets3)
    b = assembly.assemble(b, "picks", cfg.budgets3, already="first").select("user_id", "items", "target", "first", "before_last")
    if cfg.semantic_pad:
        b = _semantic(cut(b), users3, visited3, second, pads, already="first")
    b = pads.random(b, second, already="first")
    out = b.select("user_id", F.concat("first", F.when(F.col("before_last").isNotNull(), F.col("items")).otherwise(_none())).alias("items"), "target")
    if cfg.semantic_pad:
        # what a user lacks in the end (the one with a single history item) comes from outside of the first source, of which as many are known as the first list is long
        out = cut(out)
        short = out.filter(F.size("items") < first + second)
        got = pads.outside(users2.join(short.select("user_id"), "user_id", "left_semi"), visited2, first)
        out = out.join(got, "user_id", "left").withColumn("items", assembly.top_up(F.col("items"), F.coalesce("outside", _none()), first + second)).drop("outside")
    return pads.random(out, first + second)


def predictions(rows: DataFrame, top_k: int = 10) -> DataFrame:
    """``user_id, item_ids, gt_ids`` as they are stored: lists cut to ``top_k``."""
    return rows.select("user_id", F.slice("items", 1, top_k).alias("item_ids"), F.array("target").alias("gt_ids"))
