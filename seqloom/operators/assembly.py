"""Budgeted assembly of ring picks with overflow and padding, as one fold over arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordering import numbered
from seqloom.runtime import cut

_EMPTY = "array<bigint>"


def ring_lists(ranked: DataFrame, hops: int, key: str = "q") -> DataFrame:
    """``q, picks``: an array with one array of items per ring, best first, from ``(q, hop, rank, item)``."""
    per = ranked.filter(F.col("hop").between(1, hops)).groupBy(key, "hop").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("_r"))
    m = per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("hop", F.col("_r.item").alias("items")))).alias("_m"))
    return m.select(key, F.array(*[F.coalesce(F.try_element_at("_m", F.lit(h)), F.array().cast(_EMPTY)) for h in range(1, hops + 1)]).alias("picks"))


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def fold(picks: Column, budgets: Sequence[int], already: Column | None = None) -> Column:
    """The folded list: per ring, leftovers of earlier rings fill what its own picks fall short of the budget, then come its picks; the rest waits.

    At the end, leftovers top the list up to the sum of the budgets. Picks that were chosen before (in ``already``, in the result
    or among the leftovers) are passed over. One aggregate over the rings, so the expression doesn't grow with their number.
    """
    empty = F.array().cast(_EMPTY)
    rings = F.zip_with(picks, F.lit(list(budgets)).cast("array<int>"), lambda items, k: F.struct(F.coalesce(items, empty).alias("items"), F.coalesce(k, F.lit(0)).alias("k")))

    def step(acc: Column, ring: Column) -> Column:
        own = F.array_except(ring["items"], already) if already is not None else ring["items"]
        fresh = F.array_except(own, F.concat(acc["res"], acc["over"]))

        def place(p: Column) -> Column:
            return _let(
                F.least(F.size(acc["over"]), F.greatest(F.lit(0), ring["k"] - F.size(p))),
                lambda t: F.struct(
                    F.concat(acc["res"], F.slice(acc["over"], F.lit(1), t), F.slice(p, F.lit(1), ring["k"] - t)).alias("res"),
                    F.concat(F.slice(acc["over"], t + 1, F.size(acc["over"])), F.slice(p, ring["k"] - t + 1, F.size(p))).alias("over"),
                ),
            )

        return _let(fresh, place)

    total = sum(budgets)
    start = F.struct(empty.alias("res"), empty.alias("over"))
    return F.aggregate(rings, start, step, lambda acc: F.concat(acc["res"], F.slice(acc["over"], F.lit(1), F.greatest(F.lit(total) - F.size(acc["res"]), F.lit(0)))))


def assemble(rows: DataFrame, picks: str, budgets: Sequence[int], out: str = "items", already: str | None = None) -> DataFrame:
    """Adds the folded list; rows without any picks get an empty one."""
    none = F.array_repeat(F.array().cast(_EMPTY), len(budgets))
    return rows.withColumn(out, fold(F.coalesce(picks, none), budgets, F.col(already) if already else None))


def top_up(items: Column, more: Column, total: int, already: Column | None = None) -> Column:
    """``items`` followed by those of ``more`` that are not in it (nor in ``already``), up to ``total``."""
    fresh = F.array_except(more, F.concat(items, already) if already is not None else items)
    return F.concat(items, F.slice(fresh, F.lit(1), F.greatest(F.lit(total) - F.size(items), F.lit(0))))


def next_prime(n: int) -> int:
    """The least prime from ``n`` on."""
    p = max(n, 2)
    while any(p % d == 0 for d in range(2, int(p**0.5) + 1)):
        p += 1
    return p


def pad_pool(vertices: DataFrame) -> tuple[DataFrame, int]:
    """``item, pos``: vertices numbered from 0 in the order of their ids, and how many there are."""
    pool = cut(numbered(vertices.filter(F.col("item").isNotNull()).distinct(), ["item"], "pos"))
    return pool, pool.count()


def random_pad(short: DataFrame, pool: DataFrame, n: int, total: int, seed: int, items: str, key: str = "q", already: str | None = None) -> DataFrame:
    """``q, pad``: as many further vertices as a query's list falls short of ``total``, drawn pseudo-randomly, used ones passed over.

    Every query walks through the ``n`` numbered vertices of ``pad_pool`` in strides of its own: from md5(seed:q) follow a start and a stride
    below the next prime, so that no place comes twice and all come up in the end. A walk of as many steps as the list needs and has
    used is always enough, so a query looks up a bounded number of places and is never paired with all vertices.
    """
    prime = next_prime(n)
    used = F.concat(items, already) if already else F.col(items)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    number = lambda at: F.conv(F.substring(h, at, 12), 16, 10).cast("bigint")
    need = short.select(key, used.alias("_u"), (F.lit(total) - F.size(items)).alias("_n"), F.pmod(number(1), F.lit(prime)).alias("_a"), (F.pmod(number(13), F.lit(prime - 1)) + 1).alias("_b"))
    need = need.filter("_n > 0")
    steps = F.least(F.lit(prime).cast("bigint"), (F.col("_n") + F.size("_u") + F.lit(prime - n)).cast("bigint"))
    walk = need.select(key, "_a", "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), steps - 1)).alias("_j")).select(key, "_j", F.pmod(F.col("_a") + F.col("_j") * F.col("_b"), F.lit(prime)).alias("pos"))
    seen = walk.join(pool.select("pos", "item"), "pos").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_j", "item"))).alias("_w"))  # as many as steps
    return need.join(seen, key).select(key, F.slice(F.array_except(F.col("_w.item"), F.col("_u")), F.lit(1), F.col("_n")).alias("pad"))
