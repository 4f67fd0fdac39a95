"""Queries of the graph, vector, ranking, assembly and metric operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import assembly, graph, metrics, ranking, vectors as vec
from seqloom.operators.sequences import targets
from seqloom.plans import recommend as rec
from seqloom.plans.frames import E, L, catalogue, event_sequences, line_sequences
from seqloom.runtime import cut, table

QUERIES, SQL, query = catalogue()


# -- SQL building blocks, written from the definitions ---------------------------------------------------


def _edges(seqs: str, least: int = 1) -> str:
    """``g``: transitions of the training slices of ``seqs``, and ``w``: their weights."""
    return f"""pr AS (SELECT unnest(list_zip(seq[1:greatest(len(seq) - 3, 0)], seq[2:greatest(len(seq) - 2, 0)])) AS p FROM {seqs}),
g AS (SELECT p[1] AS src, p[2] AS dst, count(*) AS cnt FROM pr GROUP BY ALL HAVING count(*) >= {least}),
w AS (SELECT src, dst, ln(1 + cnt) / max(ln(1 + cnt)) OVER (PARTITION BY src) AS w FROM g)"""


def _rings(depth: int, sources: str = "(SELECT DISTINCT src FROM g)", tag: str = "") -> str:
    """``r1 .. rn``, ``v1 .. vn`` and ``cand`` (src, hop, item) from ``g``."""
    t = tag
    out = [
        f"s{t} AS {sources}",
        f"r1{t} AS (SELECT g.src, g.dst AS item FROM g JOIN s{t} USING (src))",
        f"v1{t} AS (SELECT src, item FROM r1{t} UNION SELECT src, src FROM s{t})",
    ]
    for h in range(2, depth + 1):
        out += [
            f"r{h}{t} AS (SELECT DISTINCT r.src, g.dst AS item FROM r{h - 1}{t} r JOIN g ON r.item = g.src ANTI JOIN v{h - 1}{t} v ON v.src = r.src AND v.item = g.dst)",
            f"v{h}{t} AS (SELECT * FROM v{h - 1}{t} UNION ALL SELECT * FROM r{h}{t})",
        ]
    out.append(f"cand{t} AS (" + " UNION ALL ".join(f"SELECT src, {h} AS hop, item FROM r{h}{t}" for h in range(1, depth + 1)) + ")")
    return ",\n".join(out)


_EMB = """em AS (
  SELECT vec_id AS item, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e
  FROM embeddings)"""


def _score(alpha: float = 0.5, tag: str = "") -> str:
    """``sc``: candidates scored against the source's own vector."""
    return f"""sc{tag} AS (
  SELECT c.src, c.hop, c.item, round(coalesce(list_inner_product(a.e, b.e), 0.0) + CASE WHEN c.hop = 1 THEN {alpha} * coalesce(w.w, 0.0) ELSE 0.0 END, 9) AS score
  FROM cand{tag} c LEFT JOIN em a ON a.item = c.src LEFT JOIN em b ON b.item = c.item LEFT JOIN w ON c.hop = 1 AND w.src = c.src AND w.dst = c.item)"""


def _fold(lists: str, budgets: tuple[int, ...], out: str) -> str:
    """``out`` (q, items) from ``lists`` (q, p1 .. pn), a CTE per ring."""
    total = sum(budgets)
    steps = [f"{out}0 AS (SELECT *, CAST([] AS BIGINT[]) AS res, CAST([] AS BIGINT[]) AS ov FROM {lists})"]
    for h, k in enumerate(budgets, 1):
        steps.append(f"{out}{h}t AS (SELECT *, least(len(ov), greatest(0, {k} - len(p{h}))) AS t FROM {out}{h - 1})")
        steps.append(f"{out}{h} AS (SELECT * EXCLUDE (res, ov, t), list_concat(list_concat(res, ov[1:t]), p{h}[1:{k} - t]) AS res, list_concat(ov[t + 1:], p{h}[{k} - t + 1:]) AS ov FROM {out}{h}t)")
    steps.append(f"{out} AS (SELECT *, list_concat(res, ov[1:{total} - len(res)]) AS items FROM {out}{len(budgets)})")
    return ",\n".join(steps)


def _lists(ranked: str, q: str, hops: int) -> str:
    """Query of (q, p1 .. pn) from (q, hop, r, item)."""
    cols = ", ".join(f"coalesce(list(item ORDER BY r) FILTER (hop = {h}), []) AS p{h}" for h in range(1, hops + 1))
    return f"SELECT {q} AS q, {cols} FROM {ranked} GROUP BY {q}"


def _ranked(scored: str, k: int, q: str = "src") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {q}, hop ORDER BY score DESC, item) AS r FROM {scored} QUALIFY r <= {k}"


#: Vertices numbered from 0, and the least prime from their number on.
_POOL = """vx AS (SELECT src AS item FROM g UNION SELECT dst FROM g),
vn AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS pos FROM vx),
pn AS (SELECT n, min(p) AS p FROM (SELECT count(*) AS n FROM vx) c, (SELECT unnest(range(2, 300000)) AS p) t
  WHERE p BETWEEN n AND n + 300 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 600)) AS d) u WHERE d * d <= p AND p % d = 0) GROUP BY n)"""


def _walk(short: str, total: int, out: str, used: str = "items") -> str:
    """``out`` (user_id, pad): vertices of each user's walk that are not used, in its order."""
    return f"""{out}a AS (SELECT *, md5('42:' || user_id) AS h, {used} AS used, {total} - len(items) AS need FROM {short} WHERE len(items) < {total}),
{out}b AS (SELECT user_id, used, n, p, need, CAST('0x' || substr(h, 1, 12) AS BIGINT) % p AS a, CAST('0x' || substr(h, 13, 12) AS BIGINT) % (p - 1) + 1 AS b FROM {out}a, pn),
{out}c AS (SELECT *, unnest(range(least(p, need + len(used) + p - n))) AS j FROM {out}b),
{out} AS (SELECT user_id, list(item ORDER BY j) AS pad FROM {out}c JOIN vn ON vn.pos = (a + j * b) % p WHERE NOT list_contains(used, item) GROUP BY user_id)"""


_LAST = "SELECT DISTINCT seq[-2] AS src FROM {0}"
_E_SINGLE = f"""{E}, {_edges('es')}, {_rings(3, '(SELECT DISTINCT seq[-2] AS src FROM es)')}, {_EMB}, {_score()},
rk AS ({_ranked('sc', 10)}), li AS ({_lists('rk', 'src', 3)}), {_fold('li', (7, 2, 1), 'f')},
one AS (SELECT es.user_id, seq[-1] AS target, coalesce(f.items, []) AS items FROM es LEFT JOIN f ON f.q = seq[-2])"""


def _flat(source: str, items: str = "items", key: str = "user_id") -> str:
    return f"SELECT {key}, unnest(range(1, len({items}) + 1)) AS rank, unnest({items}) AS item_id FROM {source}"


# -- Spark building blocks -------------------------------------------------------------------------------


def _e(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sequences, edges and vectors of the events; edges are used many times over and kept."""
    seqs = event_sequences(spark, d)
    return seqs, cut(graph.transitions(seqs, "seq")), rec.unit_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")


def _l(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    seqs = line_sequences(spark, d)
    return seqs, cut(graph.transitions(seqs, "seq")), rec.unit_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")


def _ranks(df: DataFrame, items: str = "items", key: str = "user_id") -> DataFrame:
    return df.select(key, F.posexplode(items).alias("_p", "item_id")).select(key, (F.col("_p") + 1).cast("bigint").alias("rank"), "item_id")


# -- graph -----------------------------------------------------------------------------------------------


@query(f"WITH {L}, {_edges('ls')} SELECT src, dst, cnt FROM g")
def graph_transitions(spark: SparkSession, d: str) -> DataFrame:
    return graph.transitions(line_sequences(spark, d), "seq")


@query(f"WITH {E}, {_edges('es')} SELECT src, dst, cnt FROM g")
def graph_transitions_events(spark: SparkSession, d: str) -> DataFrame:
    return graph.transitions(event_sequences(spark, d), "seq")


@query(f"WITH {E}, {_edges('es')} SELECT DISTINCT src, dst FROM g")
def graph_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(graph.transitions(event_sequences(spark, d), "seq"))


@query(f"WITH {L}, {_edges('ls')} SELECT src, dst, round(w, 9) AS w FROM w")
def graph_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_weights(graph.transitions(line_sequences(spark, d), "seq")).withColumn("w", F.round("w", 9))


@query(f"WITH {L}, {_edges('ls')} SELECT src AS item FROM g UNION SELECT dst FROM g")
def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    return graph.vertices(graph.transitions(line_sequences(spark, d), "seq"))


@query("""WITH g AS (SELECT DISTINCT * FROM transition_graph WHERE src IS NOT NULL AND dst IS NOT NULL AND edge_count IS NOT NULL)
SELECT src, dst, CAST(sum(edge_count) AS BIGINT) AS cnt FROM g GROUP BY ALL""")
def domain_graph(spark: SparkSession, d: str) -> DataFrame:
    """The project's own graph, summed over training shards."""
    return graph.from_shards(table(spark, d, "transition_graph"), "src", "dst", "edge_count")


@query("""WITH t AS (SELECT DISTINCT user_id, list_filter(sequence_data, lambda x: x IS NOT NULL) AS seq FROM testing WHERE user_id IS NOT NULL),
u AS (SELECT * FROM t WHERE len(seq) >= 3),
p AS (SELECT unnest(list_zip(seq[1:len(seq) - 3], seq[2:len(seq) - 2])) AS p FROM u)
SELECT p[1] AS src, p[2] AS dst, count(*) AS cnt FROM p GROUP BY ALL""")
def domain_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Transitions counted from the full sequences, without their last two items; null elements are skipped."""
    t = table(spark, d, "testing").filter("user_id IS NOT NULL").select("user_id", F.array_compact("sequence_data").alias("seq")).distinct()
    return graph.transitions(t.filter(F.size("seq") >= 3), "seq")


@query(f"WITH {E}, {_edges('es')}, {_rings(3)} SELECT src, hop, item FROM cand")
def rings_1_to_3(spark: SparkSession, d: str) -> DataFrame:
    return graph.rings(_e(spark, d)[1], depth=3)[0]


@query(f"WITH {L}, {_edges('ls')}, {_rings(2)} SELECT src, hop, count(*) AS n FROM cand GROUP BY ALL")
def rings_sizes_baskets(spark: SparkSession, d: str) -> DataFrame:
    return graph.hop_degrees(graph.rings(_l(spark, d)[1], depth=2)[0])


@query(f"WITH {E}, {_edges('es')}, {_rings(3)} SELECT src, item FROM v3")
def ring_visited(spark: SparkSession, d: str) -> DataFrame:
    return graph.rings(_e(spark, d)[1], depth=3)[1]


@query(f"""WITH {E}, {_edges('es', 2)}, {_rings(1, '(SELECT DISTINCT seq[-2] AS src FROM es)')}, nn AS (SELECT 1 + max(list_max(seq)) AS n FROM es)
SELECT user_id, count(*) AS n FROM (SELECT user_id, seq, unnest(range((SELECT n FROM nn))) AS i FROM es) x
WHERE NOT list_contains(seq[1:len(seq) - 1], i) AND NOT EXISTS (SELECT 1 FROM v1 WHERE v1.src = seq[-2] AND v1.item = i) GROUP BY user_id""")
def ring_catch_all(spark: SparkSession, d: str) -> DataFrame:
    """How many ids are outside of ring 1 (of edges counted at least twice) and of the history, for users who have any."""
    seqs, edges, _ = _e(spark, d)
    t = targets(seqs, "user_id", "seq")
    _, visited = graph.rings(edges.filter("cnt >= 2"), t.select(F.col("last").alias("src")), 1)
    users = t.select(F.col("user_id").alias("user"), F.col("last").alias("src"), "history")
    return graph.outside_sizes(users, visited, rec.n_items_of(edges, seqs, "seq")).withColumnRenamed("user", "user_id").filter("n > 0")


# -- vectors ---------------------------------------------------------------------------------------------


@query(f"WITH {_EMB} SELECT item, unnest(range(1, len(e) + 1)) AS d, round(unnest(e), 6) AS x FROM em")
def emb_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = rec.unit_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    return v.select("item", F.posexplode("e").alias("p", "x")).select("item", (F.col("p") + 1).cast("bigint").alias("d"), F.round("x", 6).alias("x"))


@query(f"WITH {E}, {_EMB} SELECT user_id, unnest(range(1, len(e) + 1)) AS d, round(unnest(e), 6) AS x FROM es JOIN em ON em.item = seq[-2]")
def anchor_single(spark: SparkSession, d: str) -> DataFrame:
    seqs, _, v = _e(spark, d)
    a = vec.anchors_single(targets(seqs, "user_id", "seq"), "user_id", "last", v)
    return a.select("user_id", F.posexplode("anchor").alias("p", "x")).select("user_id", (F.col("p") + 1).cast("bigint").alias("d"), F.round("x", 6).alias("x"))


@query(f"""WITH {E}, {_EMB}, h AS (SELECT user_id, unnest(seq[greatest(len(seq) - 3, 1):len(seq) - 1]) AS item, least(3, len(seq) - 1) AS n FROM es),
x AS (SELECT user_id, unnest(range(1, len(e) + 1)) AS d, unnest(e) AS x, n FROM h JOIN em USING (item)),
m AS (SELECT user_id, d, sum(x) / n AS m FROM x GROUP BY user_id, d, n),
z AS (SELECT user_id, sqrt(sum(m * m)) AS z FROM m GROUP BY user_id)
SELECT user_id, d, round(m / greatest(z, 1e-8), 6) AS x FROM m JOIN z USING (user_id)""")
def anchor_mean_last_n(spark: SparkSession, d: str) -> DataFrame:
    seqs, _, v = _e(spark, d)
    a = vec.anchors_mean(targets(seqs, "user_id", "seq"), "user_id", "history", v, 3)
    return a.select("user_id", F.posexplode("anchor").alias("p", "x")).select("user_id", (F.col("p") + 1).cast("bigint").alias("d"), F.round("x", 6).alias("x"))


@query("""WITH t AS (SELECT vec_id % 50 AS k, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS m, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT k, m, unnest(range(1, len(e) + 1)) AS d, unnest(e) AS x FROM t)
SELECT k, d, round(sum(x * m) / greatest(sum(m), 1), 6) AS x FROM x GROUP BY ALL""")
def masked_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stand for tokens, 50 texts share them, every third is masked out."""
    t = table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("k"), F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("m"), "embedding")
    p = vec.masked_mean_pool(t, "k", "embedding", "m")
    return p.select("k", F.posexplode("v").alias("p", "x")).select("k", (F.col("p") + 1).cast("bigint").alias("d"), F.round("x", 6).alias("x"))


# -- scores and top-k ------------------------------------------------------------------------------------


def _e_scored(spark: SparkSession, d: str, depth: int) -> DataFrame:
    _, edges, v = _e(spark, d)
    ring, _ = graph.rings(edges, depth=depth)
    src = edges.select("src").distinct()
    anchors = src.join(v, src["src"] == v["item"]).select(F.col("src").alias("q"), vec.normalise(F.col("e"), 1e-8).alias("anchor"))
    return ranking.score(ring.select(F.col("src").alias("q"), "src", "hop", "item"), anchors, v, graph.edge_weights(edges))


@query(f"WITH {E}, {_edges('es')}, {_rings(1)}, {_EMB}, {_score()} SELECT src, item, round(score, 6) AS score FROM sc")
def score_ring1(spark: SparkSession, d: str) -> DataFrame:
    return _e_scored(spark, d, 1).select("src", "item", F.round("score", 6).alias("score"))


@query(f"WITH {E}, {_edges('es')}, {_rings(3)}, {_EMB}, {_score()}, rk AS ({_ranked('sc', 10)}) SELECT src, hop, r AS rank, item FROM rk")
def topk_per_ring(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_per_ring(_e_scored(spark, d, 3), 10).select("src", "hop", "rank", "item")


@query(f"""WITH {E}, {_edges('es')}, {_rings(2)}, {_EMB}, {_score()}, tk AS ({_ranked('sc', 3)}),
ms AS (SELECT * FROM sc ANTI JOIN tk ON tk.src = sc.src AND tk.item = sc.item AND tk.hop = 1), rk AS ({_ranked('ms', 4)})
SELECT src, hop, r AS rank, item FROM rk""")
def topk_masked(spark: SparkSession, d: str) -> DataFrame:
    """The best 4 of each ring after the best 3 of ring 1 are taken; ranked to 4 + 3 first, then masked."""
    ranked = ranking.top_per_ring(_e_scored(spark, d, 2), 7)
    taken = ranked.filter("hop = 1 AND rank <= 3").select("q", "item")
    return ranking.without(ranked, taken, 4).select("src", "hop", "rank", "item")


_OUT = f"""nn AS (SELECT 1 + max(list_max(seq)) AS n FROM es), {_EMB},
x AS (SELECT user_id, seq, unnest(range((SELECT n FROM nn))) AS item FROM es),
ou AS (SELECT x.user_id, x.item, round(coalesce(list_inner_product(a.e, b.e), 0.0), 9) AS score FROM x LEFT JOIN em a ON a.item = seq[-2] LEFT JOIN em b ON b.item = x.item
  WHERE NOT list_contains(seq[1:len(seq) - 1], x.item) AND NOT EXISTS (SELECT 1 FROM v1 WHERE v1.src = seq[-2] AND v1.item = x.item))"""


@query(f"""WITH {E}, {_edges('es', 2)}, {_rings(1, '(SELECT DISTINCT seq[-2] AS src FROM es)')}, {_OUT}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank, item FROM ou QUALIFY rank <= 10""")
def pad_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The 10 closest ids outside of ring 1 (of edges counted at least twice) and of the history."""
    seqs, edges, v = _e(spark, d)
    t = targets(seqs, "user_id", "seq")
    users = t.select("user_id", F.col("last").alias("src"), "history")
    _, visited = graph.rings(edges.filter("cnt >= 2"), users.select("src"), 1)
    pads = rec._Pads(edges, v, rec.Config(), rec.n_items_of(edges, seqs, "seq"))
    return _ranks(pads.outside(users, visited, 10), "outside").withColumnRenamed("item_id", "item")


# -- assembly and methods --------------------------------------------------------------------------------


@query(f"WITH {E}, {_edges('es')}, {_rings(3)}, {_EMB}, {_score()}, rk AS ({_ranked('sc', 10)}), li AS ({_lists('rk', 'src', 3)}), {_fold('li', (7, 2, 1), 'f')} {_flat('f', key='q')}")
def assemble_overflow(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.top_per_ring(_e_scored(spark, d, 3), 10)
    rows = assembly.assemble(assembly.ring_lists(ranked, 3), "picks", (7, 2, 1))
    return _ranks(rows, key="q")


_PAD = f"""{L}, {_edges('ls', 2)}, {_POOL},
{_rings(1, '(SELECT DISTINCT seq[-2] AS src FROM ls)')}, {_EMB}, {_score()}, rk AS ({_ranked('sc', 10)}), li AS ({_lists('rk', 'src', 1)}),
{_fold('li', (10,), 'f')}, u AS (SELECT user_id, coalesce(f.items, []) AS items FROM ls LEFT JOIN f ON f.q = seq[-2]),
{_walk('u', 10, 'pd')},
al AS (SELECT u.user_id, list_concat(items, coalesce(pad, [])[1:10 - len(items)]) AS items FROM u LEFT JOIN pd USING (user_id))"""


@query(f"WITH {_PAD} {_flat('al')}")
def pad_random(spark: SparkSession, d: str) -> DataFrame:
    """One ring of edges counted at least twice: nearly every list falls short and is padded."""
    seqs, edges, v = _l(spark, d)
    cfg = rec.Config(budgets=(10,), max_hops=1)
    return _ranks(rec.single_source(seqs, edges.filter("cnt >= 2"), v, cfg))


@query(f"WITH {_E_SINGLE} {_flat('one')}")
def recommend_single_source(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(rec.single_source(*_e(spark, d)))


@query(f"""WITH {E}, {_edges('es')}, {_rings(3, '(SELECT DISTINCT seq[-2] AS src FROM es)')}, {_EMB},
h AS (SELECT user_id, unnest(seq[greatest(len(seq) - 3, 1):len(seq) - 1]) AS item, least(3, len(seq) - 1) AS n FROM es),
x AS (SELECT user_id, unnest(range(1, len(e) + 1)) AS d, unnest(e) AS x, n FROM h JOIN em USING (item)),
m AS (SELECT user_id, d, sum(x) / n AS m FROM x GROUP BY user_id, d, n),
an AS (SELECT user_id, list(m ORDER BY d) AS m, greatest(sqrt(sum(m * m)), 1e-8) AS z FROM m GROUP BY user_id),
sc AS (SELECT es.user_id, c.hop, c.item, round(coalesce(list_inner_product(an.m, b.e) / z, 0.0) + CASE WHEN c.hop = 1 THEN 0.5 * coalesce(w.w, 0.0) ELSE 0.0 END, 9) AS score
  FROM es JOIN cand c ON c.src = seq[-2] LEFT JOIN an USING (user_id) LEFT JOIN em b ON b.item = c.item LEFT JOIN w ON c.hop = 1 AND w.src = c.src AND w.dst = c.item),
rk AS ({_ranked('sc', 10, 'user_id')}), li AS ({_lists('rk', 'user_id', 3)}), {_fold('li', (7, 2, 1), 'f')},
one AS (SELECT es.user_id, coalesce(f.items, []) AS items FROM es LEFT JOIN f ON f.q = es.user_id) {_flat('one')}""")
def recommend_single_mean3(spark: SparkSession, d: str) -> DataFrame:
    """Scored against the mean of the last three items, which takes the way per user."""
    return _ranks(rec.single_source(*_e(spark, d), rec.Config(last_n=3)))


@query(f"""WITH {L}, {_edges('ls')}, {_rings(2, '(SELECT DISTINCT seq[-2] AS src FROM ls)')}, {_EMB}, {_score()},
rk AS ({_ranked('sc', 10)}), li AS ({_lists('rk', 'src', 2)}), {_fold('li', (8, 2), 'f')},
one AS (SELECT ls.user_id, coalesce(f.items, []) AS items FROM ls LEFT JOIN f ON f.q = seq[-2]) {_flat('one')}""")
def recommend_single_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Two rings on the larger graph of the orders."""
    seqs = cut(line_sequences(spark, d))
    return _ranks(rec.single_source(seqs, graph.transitions(seqs, "seq"), rec.unit_vectors(table(spark, d, "embeddings"), "vec_id", "embedding"), rec.Config(budgets=(8, 2))))


@query(f"""WITH {E}, {_edges('es', 2)}, {_rings(1, '(SELECT DISTINCT seq[-2] AS src FROM es)')}, {_EMB}, {_score()},
rk AS ({_ranked('sc', 40)}), li AS ({_lists('rk', 'src', 1)}), {_fold('li', (40,), 'f')},
u AS (SELECT user_id, seq, coalesce(f.items, []) AS items FROM es LEFT JOIN f ON f.q = seq[-2]),
{_OUT.replace(_EMB + ",", "")},
k AS (SELECT ou.*, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS r FROM ou QUALIFY r <= 40),
p AS (SELECT user_id, list(item ORDER BY r) AS pad FROM k GROUP BY user_id),
sp AS (SELECT u.user_id, list_concat(items, list_filter(coalesce(pad, []), lambda y: NOT list_contains(items, y))[1:40 - len(items)]) AS items FROM u LEFT JOIN p USING (user_id)),
{_POOL}, {_walk('sp', 40, 'pd')},
al AS (SELECT sp.user_id, list_concat(items, coalesce(pad, [])[1:40 - len(items)]) AS items FROM sp LEFT JOIN pd USING (user_id)) {_flat('al')}""")
def recommend_single_semantic_pad(spark: SparkSession, d: str) -> DataFrame:
    """Lists of 40 from one ring of edges counted at least twice: topped up by closeness, then by the pseudo-random draw."""
    seqs, edges, v = _e(spark, d)
    return _ranks(rec.single_source(seqs, edges.filter("cnt >= 2"), v, rec.Config(budgets=(40,), max_hops=1, semantic_pad=True)))


@query(f"""WITH {E}, {_edges('es', 2)}, {_rings(1, '(SELECT DISTINCT seq[-2] AS src FROM es)')}, {_OUT}, {_score()},
rk AS ({_ranked('sc', 10)}), l1 AS ({_lists('rk', 'src', 1)}),
k AS (SELECT ou.*, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS r FROM ou QUALIFY r <= 10),
l2 AS (SELECT user_id, list(item ORDER BY r) AS p2 FROM k GROUP BY user_id),
li AS (SELECT es.user_id AS q, coalesce(p1, []) AS p1, coalesce(p2, []) AS p2, CAST([] AS BIGINT[]) AS p3 FROM es LEFT JOIN l1 ON l1.q = seq[-2] LEFT JOIN l2 USING (user_id)),
{_fold('li', (7, 2, 1), 'f')}, u AS (SELECT q AS user_id, items FROM f), {_POOL}, {_walk('u', 10, 'pd')},
al AS (SELECT u.user_id, list_concat(items, coalesce(pad, [])[1:10 - len(items)]) AS items FROM u LEFT JOIN pd USING (user_id)) {_flat('al')}""")
def recommend_single_explicit1(spark: SparkSession, d: str) -> DataFrame:
    """One ring of edges counted at least twice is expanded; the next one is everything outside of it and of the history."""
    seqs, edges, v = _e(spark, d)
    return _ranks(rec.single_source(seqs, edges.filter("cnt >= 2"), v, rec.Config(explicit_depth=1)))


@query(f"""WITH {L}, lx AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN seq[1:2] ELSE seq END AS seq FROM ls), {_edges('lx', 2)}, {_POOL},
{_rings(2, '(SELECT DISTINCT seq[-2] AS src FROM lx)')}, {_EMB}, {_score()}, rk AS ({_ranked('sc', 6)}), li AS ({_lists('rk', 'src', 2)}), {_fold('li', (5, 1), 'f')},
a0 AS (SELECT lx.user_id, seq, coalesce(f.items, []) AS items FROM lx LEFT JOIN f ON f.q = seq[-2]), {_walk('a0', 6, 'pa')},
a AS (SELECT a0.user_id, seq, list_concat(items, coalesce(pad, [])[1:6 - len(items)]) AS first FROM a0 LEFT JOIN pa USING (user_id)),
{_rings(2, '(SELECT DISTINCT seq[-3] AS src FROM lx WHERE len(seq) > 2)', 'y')}, {_score(tag='y')},
my AS (SELECT a.user_id, s.hop, s.item, s.score FROM a JOIN scy s ON s.src = seq[-3] WHERE len(seq) > 2 AND NOT list_contains(first, s.item)),
ry AS ({_ranked('my', 4, 'user_id')}), ly AS ({_lists('ry', 'user_id', 2)}), {_fold('ly', (3, 1), 'h')},
b0 AS (SELECT a.user_id, seq, first, coalesce(h.items, []) AS items FROM a LEFT JOIN h ON h.q = a.user_id), {_walk('b0', 4, 'pb', 'list_concat(items, first)')},
c0 AS (SELECT b0.user_id, CASE WHEN len(seq) > 2 THEN list_concat(first, list_concat(items, coalesce(pad, [])[1:4 - len(items)])) ELSE first END AS items FROM b0 LEFT JOIN pb USING (user_id)),
{_walk('c0', 10, 'pc')},
al AS (SELECT c0.user_id, list_concat(items, coalesce(pad, [])[1:10 - len(items)]) AS items FROM c0 LEFT JOIN pc USING (user_id)) {_flat('al')}""")
def recommend_two_source_padded(spark: SparkSession, d: str) -> DataFrame:
    """Edges counted at least twice, and every seventh user with a single history item: nearly all lists are padded, some have no second source."""
    seqs = line_sequences(spark, d).withColumn("seq", F.when(F.col("user_id") % 7 == 0, F.slice("seq", 1, 2)).otherwise(F.col("seq")))
    edges = cut(graph.transitions(seqs, "seq").filter("cnt >= 2"))
    return _ranks(rec.two_source(seqs, edges, rec.unit_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")))


@query(f"""WITH {E}, {_edges('es')}, {_rings(2, '(SELECT DISTINCT seq[-2] AS src FROM es)')}, {_EMB}, {_score()},
rk AS ({_ranked('sc', 6)}), li AS ({_lists('rk', 'src', 2)}), {_fold('li', (5, 1), 'f')},
a AS (SELECT user_id, seq, coalesce(f.items, []) AS first FROM es LEFT JOIN f ON f.q = seq[-2]),
{_rings(2, '(SELECT DISTINCT seq[-3] AS src FROM es)', 'y')}, {_score(tag='y')},
my AS (SELECT a.user_id, s.hop, s.item, s.score FROM a JOIN scy s ON s.src = seq[-3] WHERE NOT list_contains(first, s.item)),
ry AS ({_ranked('my', 4, 'user_id')}), ly AS ({_lists('ry', 'user_id', 2)}), {_fold('ly', (3, 1), 'h')},
b AS (SELECT a.user_id, list_concat(first, coalesce(h.items, [])) AS items FROM a LEFT JOIN h ON h.q = a.user_id) {_flat('b')}""")
def recommend_two_source(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(rec.two_source(*_e(spark, d)))


# -- metrics ---------------------------------------------------------------------------------------------

_MET = f"""{_E_SINGLE}, p AS (SELECT coalesce(list_position(items, target), 0) AS r FROM one), k AS (SELECT unnest([1, 5, 10]) AS k)"""


@query(f"WITH {_MET} SELECT k, count(*) AS n_users, round(avg(CASE WHEN r BETWEEN 1 AND k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM p, k GROUP BY k")
def metric_recall(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.ranking_metrics(rec.single_source(*_e(spark, d)), "items", "target")
    return m.select("k", "n_users", F.round("recall", 6).alias("recall"))


@query(f"WITH {_MET} SELECT k, count(*) AS n_users, round(avg(CASE WHEN r BETWEEN 1 AND k THEN 1 / log2(r + 1) ELSE 0.0 END), 6) AS ndcg FROM p, k GROUP BY k")
def metric_ndcg(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.ranking_metrics(rec.single_source(*_e(spark, d)), "items", "target")
    return m.select("k", "n_users", F.round("ndcg", 6).alias("ndcg"))
