"""Garbled text from a wrong character encoding: find it, and undo it where possible.

Adjacent character pairs are counted over all texts and scored by their mutual information; maximal-scoring segments of
improbable pairs isolate suspicious runs, and inverse mappings (encode with the codec that was wrongly
used, decode with the right one) are tried on those runs alone. A mapping is kept when the result is far
likelier under the corpus than the run itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.lookalike import transducer
from seqloom.llm.segments import maximal_segments
from seqloom.runtime import cut, distribute, local_copy

# Codecs that text is wrongly read with, and codecs that it was written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman", "koi8_r", "cp866", "iso8859_5", "cp850", "iso8859_2", "cp1253", "cp1254", "cp1257", "iso8859_15", "iso8859_7", "mac_cyrillic")
WRITTEN_IN = ("cp1251", "koi8_r", "cp866", "iso8859_5", "cp1252", "cp1250", "shift_jis", "euc_jp", "gbk", "big5", "euc_kr", "cp437", "mac_roman", "cp1253")
#: So many pairs, the most frequent ones, are held in the tasks' memory. The others, however many, are looked up in a sorted file.
MAX_PAIRS = 1_000_000
#: A run is replaced when this much log-likelihood is gained, in total and per character of the run.
GAIN, GAIN_PER_CHAR = 4.0, 0.5
UNSEEN, CEILING = 3.0, 2.0
_WIDE = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=64)
def _to_bytes(codec: str) -> dict[int, int]:
    """Character to byte; bytes that the codec leaves undefined stand for the control character of the same number, as lenient readers have it."""
    out = {}
    for b in range(256):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


@lru_cache(maxsize=64)
def _signs(codec: str) -> frozenset[str]:
    return frozenset(map(chr, _to_bytes(codec)))


def _encode(s: str, codec: str) -> bytes | None:
    if not _signs(codec).issuperset(s):
        return None
    m = _to_bytes(codec)
    try:
        return bytes([m[ord(c)] for c in s])
    except KeyError:
        return None


def from_utf8(s: str, codec: str) -> str | None:
    """``s`` read again as UTF-8, if its bytes under ``codec`` are valid and differ."""
    raw = _encode(s, codec)
    if raw is None:
        return None
    try:
        out = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return out if out != s else None


@lru_cache(maxsize=1)
def _char_maps() -> list[dict[str, str]]:
    """For each pair of single-byte codecs: the character that one stands for under the other, where they differ or are plain."""
    out = []
    for read in READ_AS:
        for written in ("cp1251", "koi8_r", "cp866", "iso8859_5", "cp1252", "cp1250", "cp1253"):
            if read == written:
                continue
            back = {b: chr(c) for c, b in _to_bytes(written).items()}
            m = {chr(c): back[b] for c, b in _to_bytes(read).items() if b in back and back[b] not in "\r\n" and not "\x80" <= back[b] <= "\x9f"}
            out.append(m)
    return out


def _clean_parts(text: str) -> list[str]:
    """The text without runs that are valid UTF-8 under some codec, so that garbled runs don't vouch for themselves."""
    if text.isascii():
        return [text]
    parts, at = [], 0
    for m in _WIDE.finditer(text):
        if "�" in m.group() or any("\x80" <= c <= "\x9f" for c in m.group()) or (len(m.group()) > 1 and any(from_utf8(m.group(), c) for c in READ_AS)):
            parts.append(text[at : m.start()])
            at = m.end()
    parts.append(text[at:])
    return parts


class _Kept(dict):
    """Values of pairs, computed when first asked for; a bounded number is kept."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, pair: tuple[str, str]) -> float:
        value = self.compute(*pair)
        if len(self) < 500_000:
            self[pair] = value
        return value


class PairModel:
    """Character pairs of a corpus: ``x, y`` code points with counts ``n``.

    ``first`` and ``second``: how often each character is the first or second of any pair, if ``x, y, n`` are not all pairs. ``rest``: sorted
    keys (see ``pair_key``) and counts of the others, none of which is more frequent than any of ``x, y``.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, first: dict[str, int] | None = None, second: dict[str, int] | None = None, rest: tuple[np.ndarray, np.ndarray] | None = None):
        self.rest, self.least = rest, int(n.min()) if len(n) else 1 << 62
        self.pair = dict(zip(zip(map(chr, x.tolist()), map(chr, y.tolist())), n.tolist()))
        a_sum: Counter = Counter()
        b_sum: Counter = Counter()
        for (a, b), k in self.pair.items():
            a_sum[a] += k
            b_sum[b] += k
        self.first, self.second = first or a_sum, second or b_sum
        self.total = float(sum(self.first.values())) or 1.0
        self.memo: dict[tuple[str, str], tuple[float, float]] = {}
        self.suspicion, self.likelihood = _Kept(lambda a, b: self.of(a, b)[0]), _Kept(lambda a, b: self.of(a, b)[1])

    def counts(self, pairs: list[tuple[str, str]]) -> list[int]:
        """How often each of the pairs occurs."""
        out = [self.pair.get(p, 0) for p in pairs]
        if self.rest is not None and not all(out):
            keys, n = self.rest
            want = np.array([pair_key(ord(a), ord(b)) for a, b in pairs], np.int64)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            out = [c or (int(m) if ok else 0) for c, m, ok in zip(out, n[at], keys[at] == want)]
        return out

    def rival(self, a: str, b: str, over: int) -> int:
        """Count of the most frequent pair that (a, b) stands for under another codec; 0 if none is over ``over``."""
        pairs = [(m[a], m[b]) for m in _char_maps() if a in m and b in m and (m[a], m[b]) != (a, b)]
        best = max((self.pair.get(p, 0) for p in pairs), default=0)
        if not best and pairs and self.rest is not None and self.least > over:  # a pair of the rest can't be more frequent than one of the table
            best = max(self.counts(pairs))
        return best if best > over else 0

    def of(self, a: str, b: str) -> tuple[float, float]:
        """``(suspicion, log-likelihood of b after a)``. Suspicion is the negative mutual information, discounted for rare pairs."""
        got = self.memo.get((a, b))
        if got is None:
            c, ca, cb, n = self.pair.get((a, b)) or (self.counts([(a, b)])[0] if self.rest is not None else 0), self.first.get(a, 0), self.second.get(b, 0), self.total
            k = 20.0
            vouched = c
            if c:
                rare = c / (c + 1) * min(ca, cb) / (min(ca, cb) + 1)
                s = max(-CEILING, -math.log(c * n / (ca * cb)) * rare) - 0.1
                # A pair of a wrong encoding vouches for itself where that error is common; but what it stands for is more common still.
                if a > "\x7f" or b > "\x7f":
                    rival = self.rival(a, b, 4 * c + 4)
                    if rival:
                        s = min(UNSEEN, math.log(rival / c))
                        if a > "\x7f" and b > "\x7f":
                            vouched = 0
            else:
                s = UNSEEN
            got = s, math.log((vouched + k * (cb + 0.05) / (n + 1)) / (ca + k))
            if len(self.memo) < 500_000:
                self.memo[a, b] = got
        return got

    def ll(self, s: str) -> float:
        return sum(map(self.likelihood.__getitem__, zip(s, s[1:])))


class Repairer:
    """Finds and undoes garbled runs with a model of the corpus."""

    def __init__(self, model: PairModel):
        self.m = model
        self.memo: dict[tuple[str, str, str], tuple[str, tuple[str, str], float] | None] = {}

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Improbable runs, widened to the ends of their tokens, that hold a character outside of ASCII."""
        if text.isascii():
            return []
        s = list(map(self.m.suspicion.__getitem__, zip(" " + text, text + " ")))
        spans: list[list[int]] = []
        for a, b, _ in maximal_segments(s, least=2.0):
            a, b = max(0, a - 1), min(len(text), b)
            while a > 0 and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            if spans and a <= spans[-1][1] + 1:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        return [(a, b) for a, b in spans if not text[a:b].isascii()]

    def better(self, left: str, run: str, right: str) -> tuple[str, tuple[str, str], float] | None:
        """The likeliest inverse of a run, up to three mappings deep, as ``(text, (read as, written in), gain)``; None if none gains enough."""
        key = (left, run, right)
        if key in self.memo:
            return self.memo[key]
        base = self.m.ll(left + run + right)
        best, out, how = base, None, ("", "")
        frontier: list[tuple[str, tuple[str, str]]] = [(run, ("", ""))]
        for depth in range(3):
            fresh: dict[str, tuple[float, tuple[str, str]]] = {}
            for s, first in frontier:
                for codec in READ_AS:
                    raw = _encode(s, codec)
                    if raw is None:
                        continue
                    for written in ("utf-8", *WRITTEN_IN) if depth == 0 else ("utf-8",):
                        if written == codec:
                            continue
                        try:
                            d = raw.decode(written)
                        except UnicodeDecodeError:
                            continue
                        if d not in (s, run) and d not in fresh and "\x1b" not in d:
                            strange = sum(c > "\x7f" and not self.m.second.get(c) for c in d)  # characters that the corpus never holds
                            fresh[d] = self.m.ll(left + d + right) - 6.0 * strange - (0.0 if written == "utf-8" else 2.0), first if depth else (codec, written)
            # a doubly garbled run may not look better after the first mapping, so the best few stay in play
            ranked = sorted(fresh.items(), key=lambda x: x[1][0], reverse=True)[:6]
            frontier = [(d, h) for d, (_, h) in ranked]
            if ranked and ranked[0][1][0] > best:
                out, (best, how) = ranked[0]
        got = None
        if out is not None and best - base >= max(GAIN, GAIN_PER_CHAR * sum(c > "\x7f" for c in run)):
            # look-alike letters, odd widths or odd case, which are no wrong encoding, may explain the run as well
            plain = left + run + right
            others = (transducer().form(f"{left}|{run}|{right}").replace("|", ""), plain.swapcase(), plain.lower())
            if max(map(self.m.ll, others)) < best:
                got = out, how, best - base
        if len(self.memo) < 50_000:
            self.memo[key] = got
        return got

    def pieces(self, text: str) -> list[tuple[int, int, str, tuple[str, str], float]]:
        """``(start, end, restored, how, gain)`` of the garbled places: whole improbable runs, else stretches outside of ASCII within them."""
        out = []
        for a, b in self.runs(text):
            got = self.better(text[a - 1 : a] if a else " ", text[a:b], text[b : b + 1] or " ")
            if got and got[1][1] == "utf-8":
                out.append((a, b, *got))
                continue
            whole, before = got, len(out)
            for m in re.finditer(r"[^\x00-\x7f]+ ?", text[a:b]):
                i, j, s = a + m.start(), a + m.end(), m.group()
                left, right = (text[i - 1 : i] if i else " "), (text[j : j + 1] or " ")
                got = self.better(left, s, right)
                if got is None and s[-1] == " ":  # the blank may be all that is left of a no-break one, or stand for itself
                    got = self.better(left, s[:-1] + "\xa0", right)
                    if got is None and (bare := self.better(left, s[:-1], " ")):
                        got, j = bare, j - 1
                if got:
                    out.append((i, j, *got))
            if whole and not any(p[3][1] == "utf-8" for p in out[before:]):
                out[before:] = [(a, b, *whole)]
        return out

    def repair(self, text: str) -> tuple[bool, bool, str]:
        """``(garbled, whole, text)``: whether any part is garbled, whether all garbled parts could be restored, and the text with these restored.

        A mapping between single-byte codecs turns any text into some other, so it needs more than one character to
        speak for it in the whole text, or one that mixes scripts within its word.
        """
        found = self.pieces(text)
        legacy: dict[tuple[str, str], list] = {}
        for p in found:
            if p[3][1] != "utf-8":
                legacy.setdefault(p[3], []).append(p)
        trusted = {how for how, ps in legacy.items() if self.speaks(text, ps)}
        kept = [p for p in found if p[3][1] == "utf-8" or p[3] in trusted]
        for how in trusted:
            kept = self.spread(text, kept, how)
        parts, at = [], 0
        for a, b, fixed, *_ in sorted(kept):
            if a >= at:
                parts += [text[at:a], fixed]
                at = b
        out = "".join(parts) + text[at:]
        lost = any(c == "\ufffd" or "\x80" <= c <= "\x9f" and c != "\x85" for c in out)
        return bool(kept) or lost, not lost, out

    @staticmethod
    def speaks(text: str, ps: list) -> bool:
        wide = sum(sum(c > "\x7f" for c in text[a:b]) for a, b, *_ in ps)
        gain = sum(p[4] for p in ps)
        if wide >= 3:
            return gain >= 8.0 + wide
        mixed = any(_scripts(text[a:b]) > 1 and _scripts(text[max(0, a - 1) : a] + fixed + text[b : b + 1]) <= 1 for a, b, fixed, *_ in ps)
        return gain >= (6.0 if mixed else 14.0 if wide > 1 else 20.0)

    def spread(self, text: str, kept: list, how: tuple[str, str]) -> list:
        """With a mapping established for a text, further words that it fits and doesn't make less likely are restored too."""
        out = list(kept)
        for m in re.finditer(r"\S*[^\x00-\x7f]\S*", text):
            a, b = m.span()
            if any(a < q and p < b for p, q, *_ in kept):
                continue
            raw = _encode(m.group(), how[0])
            if raw is None:
                continue
            try:
                d = raw.decode(how[1])
            except UnicodeDecodeError:
                continue
            left, right = (text[a - 1 : a] if a else " "), (text[b : b + 1] or " ")
            gain = self.m.ll(left + d + right) - self.m.ll(left + m.group() + right)
            if gain > 0:
                out.append((a, b, d, how, gain))
        return out


def _scripts(s: str) -> int:
    """Number of scripts among Latin, Greek and Cyrillic."""
    import unicodedata

    return len({n.split(" ", 1)[0] for n in (unicodedata.name(c, "") for c in s if c.isalpha())} & {"LATIN", "GREEK", "CYRILLIC"})


def pair_counts(df: DataFrame, text: str) -> DataFrame:
    """``x, y, n``: how often code point y follows x, over all texts; blanks stand at both ends. Counted within each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    for p in _clean_parts(t):
                        c.update(zip(" " + p, p + " "))
            if len(c) > 500_000:
                yield out(c)
                c.clear()
        yield out(c)

    def out(c: Counter) -> pa.RecordBatch:
        x, y = [ord(a) for a, _ in c], [ord(b) for _, b in c]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(list(c.values()), pa.int64())], names=["x", "y", "n"])

    return df.select(text).mapInArrow(count, "x int, y int, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n"))


def pair_key(x, y):
    """Code points (or columns of them) as one number that sorts like the pair."""
    return x * (1 << 21) + y


def _least_count(counts: DataFrame) -> int:
    """The least count of which at most ``MAX_PAIRS`` pairs are as frequent or more."""
    held, least = 0, None
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect()  # a row per different count
    for r in sizes:
        if (held := held + r["m"]) > MAX_PAIRS:
            return least or r["n"] + 1
        least = r["n"]
    return least or 1


def _packed(counts: DataFrame) -> DataFrame:
    """``key, n``: keys and counts sorted by key, as bytes; a row for each batch, so that they pass the driver in pieces."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().astype("<i8").tobytes()], pa.binary()) for c in b.columns], names=["key", "n"])

    x, y, n = (F.col(c).cast("bigint") for c in "xyn")
    return cut(counts.select(pair_key(x, y).alias("key"), n.alias("n")).repartitionByRange("key").sortWithinPartitions("key").mapInArrow(pack, "key binary, n binary"))


def _rest(counts: DataFrame, least: int) -> tuple[str, ...]:
    """Files of the keys and of the counts of all pairs less frequent than ``least``, sorted by key; none if there are no such pairs."""
    rest = counts.filter(F.col("n") < least)
    if rest.isEmpty():
        return ()
    rest = _packed(rest)
    return tuple(distribute(counts.sparkSession, (bytes(r[0]) for r in rest.select(c).toLocalIterator()), f".{c}") for c in ("key", "n"))


@lru_cache(maxsize=2)
def _repairer(name: str, rest: tuple[str, ...] = ()) -> Repairer:
    z = np.load(local_copy(name))
    first, second = (dict(zip(map(chr, z[c][0].tolist()), z[c][1].tolist())) for c in ("first", "second"))
    return Repairer(PairModel(*z["pairs"], first, second, tuple(np.memmap(local_copy(r), "<i8", "r") for r in rest) or None))


def repair_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, garbled, whole, restored`` of each distinct row with a non-null text.

    ``garbled``: some part was decoded with a wrong encoding. ``whole``: every such part could be restored (true as well for a
    text that isn't garbled). ``restored``: the text with all restorable parts undone. Null texts give no row; empty and plain
    ASCII texts come back as they are; null keys are kept.

    Two passes over the texts: pair counts of all of them, then the search. The broadcast table holds the most frequent pairs, at most
    ``MAX_PAIRS``, and the counts of all characters over all pairs; all other pairs are in a sorted file that tasks map into memory. The search for an inverse goes up to three mappings deep and follows the six
    likeliest texts of each depth: chains of wrong encodings longer than that are found but not restored whole.
    """
    import io

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL").distinct()
    counts = cut(pair_counts(rows, "t"))
    least = _least_count(counts)
    keys, n = (np.frombuffer(b"".join(x), "<i8") for x in zip((b"", b""), *_packed(counts.filter(F.col("n") >= least)).toLocalIterator()))
    # a row per character
    chars = {name: counts.groupBy(c).agg(F.sum("n").alias("n")).toPandas().to_numpy(np.int64).T for name, c in (("first", "x"), ("second", "y"))}
    buf = io.BytesIO()
    np.savez(buf, pairs=np.stack([keys >> 21, keys & ((1 << 21) - 1), n]), **chars)
    name = distribute(df.sparkSession, buf.getvalue(), ".npz")
    rest = _rest(counts, least)
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _repairer(name, rest)
        for b in batches:
            got = [r.repair(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([g[i] for g in got], (pa.bool_(), pa.bool_(), pa.string())[i]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["k", "garbled", "whole", "restored"])

    return rows.mapInArrow(run, f"k {kind}, garbled boolean, whole boolean, restored string").withColumnRenamed("k", key)
