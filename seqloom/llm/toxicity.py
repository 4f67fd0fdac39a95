"""Abusive, hateful or sexual content: maximal-scoring segments over token log-odds.

A labelled sample says which documents hold an abusive passage, not where. Token, pair and triple log-odds with
Dirichlet priors (each order's prior is the order below) are fitted in rounds: the segments that score
highest in positive documents become the positive text of the next round, everything else stays negative. Scoring scans each
whole text once; all significant segments count, and their scores are turned
into significance by extreme-value statistics fitted on clean documents.
"""

from __future__ import annotations

import io
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.lookalike import table as visible_table
from seqloom.llm.segments import maximal_segments
from seqloom.runtime import distribute, local_copy

#: Bounds of the labelled sample that the model is fitted on.
FIT_POSITIVES, FIT_NEGATIVES = 6_000, 9_000
#: Bits of the hashed pair and triple tables.
BITS = 21
ROUNDS, FOLDS = 5, 4
PRIORS = (4.0, 3.0, 2.0)  # strength of the prior of words, pairs and triples
LOW, HIGH, SHIFT = -2.5, 5.0, 0.8

# Signs written in place of letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t"})
UNKNOWN, NUMBER, STOP, FIRST = 1, 2, 3, 8

_SPACED = re.compile(r"(?<![\w'’])(?:[^\W\d_]([._*\-])(?:[^\W\d_]\1)+[^\W\d_]|[^\W\d_](?: [^\W\d_]){3,})(?!\w|[._*\-]\w)")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ가-힣]|[.!?。！？\n]+|(?:[^\W_]|[@$€](?=\w))(?:[^\W_]|[@$€*!|+](?=[\w@$€*!|+])|['’](?=[^\W\d_]))*")
_RUNS = re.compile(r"(.)\1+")
_LONG = re.compile(r"(.)\1{2,}")
_VOWELS = re.compile(r"[aeiouyàáâãäåèéêëìíîïòóôõöùúûü*]+")


@lru_cache(maxsize=1)
def _visible():
    return str.maketrans(visible_table())


def words(text: str) -> list[str]:
    """Tokens in their visible lower-case form; letters set apart by signs or blanks are joined."""
    if not text.isascii():
        import unicodedata

        text = unicodedata.normalize("NFC", text.translate(_visible()))
    text = text.lower()
    text = _SPACED.sub(lambda m: re.sub(r"[ ._*\-]", "", m.group()), text)
    return _TOKEN.findall(text)


def plain(w: str) -> str:
    """A word with letter-like signs read as letters and repeats collapsed."""
    return _RUNS.sub(r"\1", w.translate(LEET))


@dataclass
class Model:
    vocabulary: dict[str, int]
    tables: list[np.ndarray]  # score of each word, pair and triple; the last holds -inf where the order below decides
    lam: float = 1.0
    k: float = 0.0
    cut: float = 0.0
    loose: dict[str, int] = field(default_factory=dict)  # plain, shuffled and vowel-less spellings of known words
    memo: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.loose:
            for w, k in sorted(self.vocabulary.items(), key=lambda x: x[1], reverse=True):  # the more frequent word wins
                if len(w) >= 3:
                    p = plain(w)
                    self.loose[p] = k
            for w, k in sorted(self.vocabulary.items(), key=lambda x: x[1], reverse=True):
                p = plain(w)
                if len(p) >= 4:
                    self.loose["~" + "".join(sorted(p))] = k
                bare = _VOWELS.sub("", p)
                if len(bare) >= 3 and len(w) >= 5:
                    self.loose["^" + p[0] + bare] = k

    def id_of(self, w: str) -> int:
        k = self.vocabulary.get(w)
        if k is None:
            k = self.memo.get(w)
            if k is None:
                k = self.guess(w)
                if len(self.memo) < 300_000:
                    self.memo[w] = k
        return k

    def guess(self, w: str) -> int:
        if w[0] in ".!?。！？\n":
            return STOP
        if w.isdigit():
            return NUMBER
        got = self.vocabulary.get(_LONG.sub(r"\1\1", w)) or self.vocabulary.get(_LONG.sub(r"\1", w))
        if got:
            return got
        p = plain(w)
        got = self.loose.get(p)
        if got is None and len(p) >= 4:
            got = self.loose.get("~" + "".join(sorted(p)))
        if got is None and not w.isalpha() and any(c.isalpha() for c in w):
            got = self.loose.get("^" + p[0] + _VOWELS.sub("", p))
        return got or UNKNOWN

    def ids(self, text: str) -> np.ndarray:
        f = self.id_of
        return np.fromiter(map(f, words(text)), np.int64)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        one, two, three = features(ids)
        return np.clip(combine(self.tables, one, two, three), LOW, HIGH)

    def passages(self, text: str) -> tuple[float, list[tuple[int, int, float]], int]:
        """``(score, segments, tokens)``: the document's significance and each significant segment."""
        ids = self.ids(text)
        if not len(ids):
            return 0.0, [], 0
        s = self.scores(ids)
        c = np.concatenate([[0.0], np.cumsum(s)])
        if (c - np.minimum.accumulate(c)).max() <= 0.5:
            return 0.0, [], len(ids)
        segs = maximal_segments(s.tolist(), 0.5)
        sig = [(a, b, self.significance(x, len(ids))) for a, b, x in segs]
        best = max(x for *_, x in sig)
        more = sum(max(0.0, x - self.cut) for *_, x in sig) - max(0.0, best - self.cut)
        return max(0.0, best) + max(0.0, more), sig, len(ids)

    def significance(self, score: float, tokens: int) -> float:
        """-ln of the chance that clean text of this length holds a segment that scores as high."""
        x = self.lam * score - self.k - np.log(max(tokens, 1))
        return float(x if x > 30 else -np.log1p(-np.exp(-np.exp(-x))) if x > -3 else 0.0)


def features(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, pair and triple numbers at each place; pairs and triples are hashed into ``BITS`` bits."""
    a = np.concatenate([[0, 0], ids])
    one, two = a[2:], a[1:-1]
    mask = (1 << BITS) - 1
    pair = (two * 0x9E3779B1 + one * 0x85EBCA77) & 0x7FFFFFFFFFFF
    triple = (pair * 31 + a[:-2] * 0xC2B2AE3D) & 0x7FFFFFFFFFFF
    return one, (pair ^ (pair >> 17)) & mask, (triple ^ (triple >> 19)) & mask


def combine(tables: list[np.ndarray], one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """Log-odds at each place from smoothed counts ``[pos1, n1, pos2, n2, pos3, n3, base]``."""
    pos1, n1, pos2, n2, pos3, n3, base = tables
    p = (pos1[one] + PRIORS[0] * base[0]) / (n1[one] + PRIORS[0])
    p = (pos2[two] + PRIORS[1] * p) / (n2[two] + PRIORS[1])
    p = (pos3[three] + PRIORS[2] * p) / (n3[three] + PRIORS[2])
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p)) - base[1]


def fit(texts: list[str], labels: list[int], weights: list[float] | None = None) -> Model:
    """A model from labelled texts (1 = holds an abusive passage somewhere). Without both labels nothing is ever found.

    ``weights``: how much each text counts for in the F1 that sets the cut, where the texts are a sample with other shares of the
    labels than the whole. The tables count all texts alike: held-out documents are told apart better by a mix richer in positives.
    """
    y = np.array(labels, bool)
    w_doc = np.ones(len(y)) if weights is None else np.array(weights, float)
    numbers: dict[str, int] = {}  # each word is kept once, texts are arrays of numbers
    toks = [np.array([numbers.setdefault(w, len(numbers)) for w in words(t)], np.int32) for t in texts]
    df = np.zeros(len(numbers), np.int64)
    for ws in toks:
        df[np.unique(ws)] += 1
    seen = list(numbers)
    keep = [seen[k] for k in np.argsort(-df, kind="stable") if df[k] >= 2 and seen[k][0] not in ".!?。！？\n" and not seen[k].isdigit()]
    model = Model({w: FIRST + k for k, w in enumerate(keep)}, [])
    id_of = np.array([model.id_of(w) for w in seen], np.int64)
    docs = [id_of[ws] if len(ws) else np.zeros(0, np.int64) for ws in toks]
    del toks, numbers, seen
    size1 = FIRST + len(keep)
    feats = [features(d) for d in docs]
    lens = np.array([len(d) for d in docs], np.int64)
    one, two, three = (np.concatenate([f[k] for f in feats]) if feats else np.zeros(0, np.int64) for k in range(3))
    owner = np.repeat(np.arange(len(docs)), lens)
    start = np.cumsum(lens) - lens
    fold = np.arange(len(docs)) % FOLDS
    sizes = (size1, 1 << BITS, 1 << BITS)

    def counts(mask: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(f[mask], minlength=m).astype(np.float32) for f, m in zip((one, two, three), sizes)]

    def tables(pos: list[np.ndarray], all_: list[np.ndarray], offset: float) -> list[np.ndarray]:
        base = float(pos[0].sum() + 0.5) / float(all_[0].sum() + 1.0)
        return [x for pair in zip(pos, all_) for x in pair] + [np.array([base, offset])]

    if not y.any() or y.all():
        model.tables = tables(counts(np.zeros(len(owner), bool)), counts(np.ones(len(owner), bool)), 0.0)
        model.cut, model.k = float("inf"), 50.0
        return model

    positive = y[owner]
    used = np.ones(len(owner), bool)
    inside = positive.copy()
    best = np.zeros(len(docs))
    for r in range(ROUNDS):
        rate = inside[used].mean()
        offset = float(np.log(rate / (1 - rate))) + 1.2 if r == 0 else -SHIFT
        s = np.empty(len(owner))
        for k in range(FOLDS):  # each document is scored without its own fold; one fold's tables are held at a time
            m = fold[owner] == k
            t = tables(counts(inside & used & ~m), counts(used & ~m), offset)
            s[m] = combine(t, one[m], two[m], three[m])
            del t
        s = np.clip(s, LOW, HIGH)
        inside = np.zeros(len(owner), bool)
        used = np.ones(len(owner), bool)
        for d in range(len(docs)):
            a, n = start[d], lens[d]
            if not n:
                continue
            segs = maximal_segments(s[a : a + n].tolist(), 0.5)
            best[d] = max((x for *_, x in segs), default=0.0)
            if y[d]:
                top = [g for g in segs if g[2] >= max(2.0, 0.5 * best[d])]
                for i, j, _ in top:
                    inside[a + i : a + j] = True
            elif r and best[d] > 12.0:  # most likely a mistake of its annotator
                used[a : a + n] = False
    model.tables = tables(*(counts(m & used) for m in (inside, np.ones(len(owner), bool))), -SHIFT)
    # Extreme values: in clean text the chance of a best score over S is k * length * exp(-lam * S). Both are read off the middle of
    # the distribution, as mistaken labels sit at its top.
    x = best[~y & (lens > 0)]
    n0 = float(np.exp(np.log(lens[~y & (lens > 0)]).mean())) if len(x) else 1.0
    upper = [(q, float(np.quantile(x, q))) for q in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9)] if len(x) else []
    upper = [(q, v) for q, v in upper if v > 0.5]
    if len(upper) >= 2 and upper[-1][1] > upper[0][1]:
        (q0, v0), (q1, v1) = upper[0], upper[-1]
        gumbel = lambda q: -np.log(-np.log(q))
        model.lam = float(np.clip((gumbel(q1) - gumbel(q0)) / (v1 - v0), 0.3, 2.0))
        model.k = float(model.lam * v0 - np.log(n0) - gumbel(q0))
    else:
        model.lam, model.k = 1.0, 1.0 - float(np.log(n0))
    sig = np.array([model.significance(b, n) for b, n in zip(best, lens)])
    model.cut = best_cut(sig, y, w_doc)
    return model


def best_cut(sig: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The significance from which on calling texts positive gives the highest weighted F1."""
    order = np.argsort(-sig)
    tp = np.cumsum((weights * y)[order])
    f1 = 2 * tp / (np.cumsum(weights[order]) + (weights * y).sum())
    top = int(np.argmax(f1))
    near = sig[order[min(top + 1, len(order) - 1)]]
    return float((sig[order[top]] + near) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, y, w`` of at most FIT_POSITIVES + FIT_NEGATIVES labelled documents, chosen by a hash of their id.

    ``w`` weighs both labels back to their shares of all labelled documents; it is 1 on average, and always 1 where all are taken.

    A document's label is the majority of its distinct judgements; null judgements and ties say nothing. Sampled texts are taken whole.
    """
    votes = labels.select("doc_id", "annotator", "toxic").distinct().filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    share = votes.groupBy("doc_id").agg(F.avg("toxic").alias("v")).filter("v <> 0.5").select("doc_id", (F.col("v") > 0.5).cast("int").alias("y"))
    h = F.xxhash64("doc_id")
    every = {r["y"]: r["count"] for r in share.groupBy("y").count().collect()}
    most = {1: FIT_POSITIVES, 0: FIT_NEGATIVES}
    thin = max(sum(every.values()), 1) / max(sum(min(n, most[y]) for y, n in every.items()), 1)
    parts = [share.filter(F.col("y") == y).orderBy(h).limit(n).withColumn("w", F.lit(max(every.get(y, 0) / n, 1.0) / thin)) for y, n in most.items()]
    ids = parts[0].unionByName(parts[1])
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(ids), "doc_id").orderBy(h).select("text", "y", "w")


@lru_cache(maxsize=2)
def _model(name: str) -> Model:
    with open(local_copy(name), "rb") as f:
        return pickle.load(f)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[str, Model]:
    """Fits the model on the sample and brings it to the executors."""
    rows = labelled_sample(docs, labels).collect()
    model = fit([r["text"] for r in rows], [r["y"] for r in rows], [r["w"] for r in rows])
    model.memo = {}
    buf = io.BytesIO()
    pickle.dump(model, buf, protocol=pickle.HIGHEST_PROTOCOL)
    return distribute(docs.sparkSession, buf.getvalue(), ".model"), model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, source, score, toxic, n_passages, passage`` for each distinct (doc_id, source, text).

    ``score``: significance of the document, 0 for null, empty and blank texts; ``toxic``: the score reaches the cut that the
    labelled sample asks for; ``n_passages``: significant segments; ``passage``: the words of the most
    significant one (null if there is none). Texts are scanned whole. Without usable labels nothing is toxic.
    """
    name, _ = fitted(docs, labels)
    rows = docs.select("doc_id", "source", "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(name)
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                score, segs, _ = m.passages(t) if t else (0.0, [], 0)
                strong = [g for g in segs if g[2] >= m.cut]
                first = max(strong, key=lambda g: g[2]) if strong else None
                out.append((score, bool(score >= m.cut and segs), len(strong), " ".join(words(t)[first[0] : first[1]]) if first else None))
            kinds = (pa.float64(), pa.bool_(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], names=["doc_id", "source", "score", "toxic", "n_passages", "passage"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, score double, toxic boolean, n_passages int, passage string")
