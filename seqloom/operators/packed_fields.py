"""Several values packed in one field: split by a lattice, keeping each value's place.

Quoted spans are atomic. Everything else is learned from the column itself: which marks between letters and digits separate values
and which belong to them, how frequent each value is (expectation maximisation over all unquoted text), how long values
are, and how often two values follow each other without any mark. A Viterbi pass over the lattice of known
values and unknown spans then picks the likeliest segmentation of every distinct unquoted run.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.runtime import cut

# Brackets around lists, marks that always separate, and the quote marks with their partners.
BRACKETS = "[](){}"
ALWAYS = ",;|、，；｜"
QUOTES = {"'": "'", '"': '"', "‘": "’", "“": "”", "«": "»"}
ENTITIES = {"&quot;": '"', "&#34;": '"', "&#39;": "'", "&apos;": "'"}
#: Log-odds given in advance to a mark that is no letter or digit: it rather separates.
SEPARATES = 2.0
#: Chance, before anything is learned, that two values follow each other without a mark.
GLUED = 0.1

_HARD = BRACKETS + ALWAYS + "".join(QUOTES) + "".join(QUOTES.values())
_MARKS = re.escape(_HARD)
_RUNS = re.compile(r"(?:[^\W_]|[\u0300-\u036f])+")  # letters with their accents, and digits


def _quoted(a: str, b: str) -> str:
    a, b = re.escape(a), re.escape(b)
    return rf"{a}(?:[^{b}\\]|\\.|{b}{b})*{b}(?![^\W_])"


_TOKEN = re.compile("|".join([f"(?P<q{k}>{_quoted(a, b)})" for k, (a, b) in enumerate(QUOTES.items())] + [rf"(?P<chunk>[^\s{_MARKS}]+)"]), re.S)


def unquote(span: str) -> str:
    """The value of a quoted span: doubled, backslashed and entity-coded quote marks stand for one, blanks around it are dropped."""
    close = QUOTES[span[0]]
    body = re.sub(r"\\(.)", r"\1", span[1:-1].replace(close * 2, close), flags=re.S) if close * 2 in span[1:-1] or "\\" in span else span[1:-1]
    if "&" in body:
        for k, v in ENTITIES.items():
            body = body.replace(k, v)
    return body.strip()


def atoms(text: str | None) -> list[tuple[bool, str]]:
    """``(quoted, value)`` in order; what isn't quoted comes in chunks without blanks, brackets, quote marks and the marks that always separate. Empty values and stray marks give nothing."""
    out = []
    for m in _TOKEN.finditer(text or ""):
        quoted = m.lastgroup != "chunk"
        value = unquote(m.group()) if quoted else m.group()
        if value:
            out.append((quoted, value))
    return out


def junctions(chunk: str) -> Iterator[tuple[str, str, str]]:
    """``(left, mark, right)`` for each different mark between two neighbouring runs of letters and digits."""
    before = None
    for m in _RUNS.finditer(chunk):
        if before is not None:
            for c in sorted(set(chunk[before.end() : m.start()])):
                yield before.group(), c, m.group()
        before = m


@dataclass
class Spans:
    """What is known of values as such: ``total`` values, ``fresh`` of them seen once, counts by length and by character, and the share ``glued``."""

    total: float
    fresh: float
    lengths: dict[int, float]
    chars: dict[str, float]
    glued: float = GLUED

    def __post_init__(self) -> None:
        self.n_len = sum(self.lengths.values()) or 1.0
        n = (sum(self.chars.values()) or 1.0) + len(self.chars) + 1
        self.char = {c: math.log((k + 1) / n) for c, k in self.chars.items()}
        self.rare = math.log(1 / n)
        self.log_fresh = math.log((self.fresh + 1) / (self.total + 2))
        self.log_glue = math.log(self.glued)

    def base(self, s: str) -> float:
        """Log-chance of a value's spelling: its length, then its characters. Lengths never seen share one count, less for longer ones."""
        k = self.lengths.get(len(s), 0.0)
        return math.log((k if k else 2.0 ** -min(len(s), 60)) / (self.n_len + 1)) + sum(self.char.get(c, self.rare) for c in s)

    def known(self, weight: float) -> float:
        return math.log(max(weight, 1e-9) / (self.total + 1))

    def unknown(self, s: str) -> float:
        return self.log_fresh + self.base(s)

    def splits(self, n: int) -> list[list[int]]:
        """For each start in a run of ``n`` characters, the lengths of spans that lie on some way from its start to its end in two or more spans."""
        sizes = [k for k in self.lengths if k < n]
        if not sizes or min(sizes) * 2 > n:
            return []
        ahead = [False] * (n + 1)
        ahead[n] = True
        for i in range(n - 1, -1, -1):
            ahead[i] = any(i + k <= n and ahead[i + k] for k in sizes)
        if not ahead[0]:
            return []
        here = [False] * (n + 1)
        here[0] = True
        out: list[list[int]] = []
        for i in range(n):
            out.append([k for k in sizes if i + k <= n and ahead[i + k]] if here[i] else [])
            for k in out[-1]:
                here[i + k] = True
        return out


def _edges(run: str, known: dict[str, float], spans: Spans) -> list[list[tuple[int, float]]]:
    """Per start: ``(end, score)`` of the spans that a split of ``run`` can use. A junction without a mark costs what it is worth."""
    out = []
    for i, sizes in enumerate(spans.splits(len(run))):
        row = []
        for k in sizes:
            s = run[i : i + k]
            w = known.get(s)
            row.append((i + k, (spans.unknown(s) if w is None or w < 1e-6 else spans.known(w)) + (spans.log_glue if i else 0.0)))
        out.append(row)
    return out


def whole_score(run: str, weight: float, quoted: float, spans: Spans) -> float:
    """Score per occurrence of keeping a run that stands ``weight`` times unquoted and ``quoted`` times quoted as one value.

    A value that quotes vouch for is simply known; otherwise the spelling of a new value has to be paid for, once for all its occurrences.
    """
    if quoted:
        return spans.known(weight + quoted)
    return max(spans.known(weight) + spans.base(run) / weight, spans.unknown(run))


def viterbi(run: str, known: dict[str, float], spans: Spans) -> tuple[float, list[str]]:
    """Score and parts of the likeliest split into two or more spans; ``(-inf, [])`` if there is none. The fewer parts win a tie."""
    n, edges = len(run), _edges(run, known, spans)
    if not edges:
        return -math.inf, []
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(-math.inf, 0, 0)] * n  # score, minus the number of parts, start of the last part
    for i, row in enumerate(edges):
        score, parts, _ = best[i]
        for j, lp in row:
            if (score + lp, parts - 1) > best[j][:2]:
                best[j] = (score + lp, parts - 1, i)
    out, j = [], n
    while j:
        out.append(run[best[j][2] : j])
        j = best[j][2]
    return best[n][0], out[::-1]


def expected(run: str, known: dict[str, float], spans: Spans, whole: float, weight: float) -> tuple[dict[str, float], float]:
    """Expected number of each value in ``weight`` occurrences of a run, and of junctions without a mark: forward and backward sums over the lattice."""
    n, edges = len(run), _edges(run, known, spans)
    if not edges:
        return {run: weight}, 0.0
    fore, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, row in enumerate(edges):
        if fore[i] > -math.inf:
            for j, lp in row:
                fore[j] = _add(fore[j], fore[i] + lp)
    for i in range(n - 1, -1, -1):
        for j, lp in edges[i]:
            back[i] = _add(back[i], lp + back[j])
    gap = min(max((whole - fore[n]) * weight, -700.0), 700.0)  # all occurrences of a run are one or the other
    apart = 1.0 / (1.0 + math.exp(gap))
    out: Counter = Counter({run: weight * (1.0 - apart)})
    joints = 0.0
    for i, row in enumerate(edges):
        for j, lp in row:
            p = math.exp(min(0.0, fore[i] + lp + back[j] - fore[n])) * apart * weight
            if p > 1e-9:
                out[run[i:j]] += p
                joints += p if i else 0.0
    return dict(out), joints


def others(run: str, weight: float, known: list[dict] | None) -> dict[str, float]:
    """Frequencies that a run may use: its own occurrences never vouch for parts that stand nowhere alone."""
    out = {}
    for x in known or []:
        if x["value"] != run and (x["alone"] or x["c"] > weight + 0.5):
            out[x["value"]] = x["c"] if x["alone"] else x["c"] - weight
    return out


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def separators(chunks: DataFrame, values: DataFrame) -> list[str]:
    """The marks that separate values in this column, learned from ``chunks`` (value, w) and all ``values`` (value, w) known so far.

    For each mark, the text around it is read both ways: as two values, or as one that holds the mark. A value's own occurrence never
    vouches for it: frequencies leave out the junction in question. Marks that never stand between letters or digits
    separate. One row per mark reaches the driver.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for chunk, w in zip(b.column("value").to_pylist(), b.column("w").to_pylist()):
                for t in junctions(chunk):
                    c[t] += w
                for m in set(chunk):
                    if not _RUNS.match(m):
                        c["", m, ""] += w
            cols = list(zip(*c)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in cols], pa.array(list(c.values()), pa.int64())], names=["x", "m", "y", "n"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for v, w in zip(b.column("value").to_pylist(), b.column("w").to_pylist()):
                for m in _RUNS.finditer(v):
                    c[m.group()] += w
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["value", "w"])

    t = cut(chunks.mapInArrow(cells, "x string, m string, y string, n bigint").groupBy("x", "m", "y").agg(F.sum("n").alias("n")))
    seen = [r["m"] for r in t.filter("x = ''").select("m").distinct().collect()]  # at most one row per character
    if t.filter("x <> ''").isEmpty():
        return sorted(seen)
    counts = cut(chunks.mapInArrow(runs, "value string, w bigint").unionByName(values.select("value", "w")).groupBy("value").agg(F.sum("w").alias("w")))
    total = counts.agg(F.sum("w").alias("t"), F.sum((F.col("w") == 1).cast("bigint")).alias("f")).first()
    sizes = {r["k"]: float(r["w"]) for r in counts.groupBy(F.length("value").alias("k")).agg(F.sum("w").alias("w")).collect()}
    letters = {r["c"]: float(r["w"]) for r in counts.select(F.explode(F.split("value", "")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("w")).collect() if r["c"]}
    spans = Spans(float(total["t"]), float(total["f"]), sizes, letters)
    sent = chunks.sparkSession.sparkContext.broadcast(spans)  # a number per length and character
    one = lambda side, n: counts.select(F.col("value").alias(side), F.col("w").alias(n))
    both = t.filter("x <> ''").join(one("x", "nx"), "x").join(one("y", "ny"), "y")

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for b in batches:
            c: Counter = Counter()
            for x, m, y, n, nx, ny in zip(*[b.column(k).to_pylist() for k in ("x", "m", "y", "n", "nx", "ny")]):
                two = sum(s.known(k - n) if k > n else s.unknown(v) for v, k in ((x, nx), (y, ny)))
                one_ = s.known(n - 1) if n > 1 else s.unknown(f"{x}{m}{y}")
                c[m] += n * (two - one_)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.float64())], names=["m", "s"])

    inner = both.mapInArrow(odds, "m string, s double").groupBy("m").agg(F.sum("s").alias("s")).filter(F.col("s") + SEPARATES < 0)
    held = {r["m"] for r in inner.collect()}
    return sorted(set(seen) - held)


def split_packed(df: DataFrame, ids: list[str], field: str, em_rounds: int = 3) -> DataFrame:
    """One row per value: ``ids``, ``pos`` (bigint from 1) and ``item``.

    Exact copies of a row (same ids and field) count once. Null, empty and blank fields and fields
    holding nothing but separators, brackets or empty quotes give no row. A null id is kept as it is, and rows that share their ids stay apart.
    Blanks, brackets and the marks in ``ALWAYS`` always separate, letters and digits never do, and of all other marks the column decides (see ``separators``).

    Plan: each distinct (ids, field) is parsed once. All further work is on distinct runs with their counts: candidates
    are substrings of the column's own lengths, joined with its values, and each run's lattice is solved by itself.
    Only numbers per mark, length and character reach the driver. Rows are joined with segmentations only if some run splits.
    """

    @F.pandas_udf("array<struct<quoted:boolean,value:string>>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"quoted": q, "value": v} for q, v in atoms(x)])

    rows = df.select(*ids, field).filter(F.col(field).isNotNull()).distinct()
    # rows that share their ids stay apart by a hash of the field
    parsed = cut(rows.select(*ids, F.sha2(F.col(field).cast("string"), 256).alias("_row"), parse(field).alias("_atoms")))
    parsed = parsed.filter(F.size("_atoms") > 0)  # only now: the filter would be pushed below the distinct, and the fields be parsed twice
    counts = cut(parsed.select(F.explode("_atoms").alias("a")).groupBy("a.quoted", "a.value").agg(F.count(F.lit(1)).alias("w")))
    marks = separators(counts.filter("NOT quoted").select("value", "w"), counts.filter("quoted").select("value", "w"))

    def runs_of(chunk):
        if not marks:
            return F.array(chunk)
        pattern = "[" + "".join(f"\\x{{{ord(m):x}}}" for m in marks) + "]+"
        return F.filter(F.split(chunk, pattern), lambda x: x != "")

    def unpack(a):
        return F.when(a["quoted"], F.array(a)).otherwise(F.transform(runs_of(a["value"]), lambda x: F.struct(F.lit(False).alias("quoted"), x.alias("value"))))

    pieces = parsed.select(*ids, "_row", F.flatten(F.transform("_atoms", unpack)).alias("_atoms"))
    loose = counts.filter("NOT quoted").select(F.explode(runs_of(F.col("value"))).alias("value"), "w").groupBy("value").agg(F.sum("w").alias("w"))
    whole = counts.filter("quoted").select("value", F.col("w").alias("q"))
    lexicon = cut(loose.join(whole, "value", "full").select("value", F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("q", F.lit(0)).alias("q")))
    parts = cut(_segmentations(lexicon, em_rounds).filter(F.size("parts") > 1))
    values = pieces.select(*ids, "_row", F.col("_atoms.value").alias("_v"))
    if not parts.isEmpty():
        at = pieces.select(*ids, "_row", F.posexplode("_atoms").alias("_p", "a")).filter("NOT a.quoted").select(*ids, "_row", "_p", F.col("a.value").alias("run"))
        mended = at.join(parts, "run").groupBy(*ids, "_row").agg(F.map_from_entries(F.collect_list(F.struct("_p", "parts"))).alias("_m"))
        mended = mended.select(*[F.col(c).alias(f"_id{k}") for k, c in enumerate(ids)], F.col("_row").alias("_r"), "_m")
        same = (F.col("_row") == F.col("_r"))
        for k, c in enumerate(ids):
            same = same & F.col(c).eqNullSafe(F.col(f"_id{k}"))
        pick = F.transform("_v", lambda x, i: F.coalesce(F.try_element_at("_m", i), F.array(x)))
        values = values.join(mended, same, "left").select(*ids, F.when(F.col("_m").isNull(), F.col("_v")).otherwise(F.flatten(pick)).alias("_v"))
    return values.select(*ids, F.posexplode("_v").alias("_p", "item")).select(*ids, (F.col("_p") + 1).cast("bigint").alias("pos"), "item")


def _segmentations(lexicon: DataFrame, rounds: int) -> DataFrame:
    """``run, parts`` of each unquoted run (``value, w, q``: counts unquoted and quoted): ``rounds`` of expectation maximisation, then Viterbi."""
    spark = lexicon.sparkSession
    plain = r"^[^\s" + "".join(f"\\x{{{ord(c):x}}}" for c in _HARD) + "]+$"
    usable = lexicon.filter(F.col("value").rlike(plain))  # quoted values with blanks in them can be no part of a run
    sizes = usable.groupBy(F.length("value").alias("k")).agg(F.sum(F.col("w") + F.col("q")).cast("double").alias("n"), F.sum((F.col("w") + F.col("q") == 1).cast("double")).alias("f")).collect()
    letters = usable.select(F.explode(F.split("value", "")).alias("c"), (F.col("w") + F.col("q")).alias("w")).groupBy("c").agg(F.sum("w").cast("double").alias("n")).collect()
    lengths = {r["k"]: r["n"] for r in sizes}
    spans = Spans(sum(r["n"] for r in sizes), sum(r["f"] for r in sizes), lengths, {r["c"]: r["n"] for r in letters if r["c"]})

    def shared(s: Spans):
        return spark.sparkContext.broadcast(s)  # a number per length and character

    runs = lexicon.filter("w > 0").select(F.md5("value").alias("rid"), F.col("value").alias("run"), "w", "q")
    first = shared(spans)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, list[list[int]]] = {}
        for b in batches:
            rid, sub = [], []
            for key, run in zip(b.column("rid").to_pylist(), b.column("run").to_pylist()):
                n = len(run)
                ways = memo.get(n)
                if ways is None:
                    ways = first.value.splits(n)
                    if n < 1000:
                        memo[n] = ways
                got = {run[i : i + k] for i, ks in enumerate(ways) for k in ks}
                rid += [key] * len(got)
                sub += got
                if len(sub) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(rid, pa.string()), pa.array(sub, pa.string())], names=["rid", "value"])
                    rid, sub = [], []
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.string()), pa.array(sub, pa.string())], names=["rid", "value"])

    cand = cut(runs.mapInArrow(candidates, "rid string, value string"))
    weights = usable.select("value", (F.col("w") + F.col("q")).cast("double").alias("c"), F.lit(True).alias("alone"))

    def lattices(weights_: DataFrame, some: DataFrame, how: str) -> DataFrame:
        known = cand.join(weights_, "value").groupBy("rid").agg(F.collect_list(F.struct("value", "c", "alone")).alias("known"))  # at most length x lengths of the run
        return some.join(known, "rid", how).select("run", "w", "q", "known")

    if not cand.isEmpty():
        opened = runs.join(cand.select("rid").distinct(), "rid", "left_semi")
        fixed = usable.join(opened.select(F.col("run").alias("value")), "value", "left_anti").select("value", (F.col("w") + F.col("q")).cast("double").alias("c")).withColumn("own", F.col("c"))
        for _ in range(rounds):
            now = shared(spans)

            def learn(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    c: Counter = Counter()
                    own: Counter = Counter()
                    joints = 0.0
                    for run, w, q, known in zip(*[b.column(k).to_pylist() for k in ("run", "w", "q", "known")]):
                        got, j = expected(run, others(run, w, known), now.value, whole_score(run, w, q, now.value), w)
                        joints += j
                        c.update(got)
                        c[run] += q
                        own[run] += got[run] + q
                    cols = [*c, None], [*c.values(), joints], [*(own.get(v, 0.0) for v in c), 0.0]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.float64(), pa.float64()))], names=["value", "c", "own"])

            got = cut(lattices(weights, opened, "left").mapInArrow(learn, "value string, c double, own double").groupBy("value").agg(F.sum("c").alias("c"), F.sum("own").alias("own")))
            glued = got.filter("value IS NULL").agg(F.sum("c")).first()[0] or 0.0
            weights = fixed.unionByName(got.filter("value IS NOT NULL AND c > 1e-6")).groupBy("value").agg(F.sum("c").alias("c"), F.sum("own").alias("own"))
            weights = cut(weights.select("value", "c", (F.col("own") > 0.5).alias("alone")))
            total, fresh = weights.agg(F.sum("c"), F.sum(F.when(F.col("c") <= 1.5, 1.0).otherwise(0.0))).first()
            sizes_now = {r["k"]: r["n"] for r in weights.groupBy(F.length("value").alias("k")).agg(F.sum("c").alias("n")).collect()}
            kept = {k: sizes_now.get(k, 0.0) or 1e-3 for k in lengths}  # the lattice keeps its lengths, only their chances change
            spans = Spans(total or 0.0, fresh or 0.0, kept, spans.chars, min(0.5, (glued + 0.5) / ((total or 0.0) + 1.0)))
    last = shared(spans)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for run, w, q, known in zip(*[b.column(k).to_pylist() for k in ("run", "w", "q", "known")]):
                score, way = viterbi(run, others(run, w, known), last.value)
                parts.append(way if score > whole_score(run, w, q, last.value) else [run])
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(parts, pa.list_(pa.string()))], names=["run", "parts"])

    return lattices(weights, runs, "left").mapInArrow(solve, "run string, parts array<string>")
