"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Words are counted over all documents; the frequent ones are encoded once, compiled into a minimal
acyclic transducer and memory-mapped by every worker. Words outside of it are merged exactly, so the
result never depends on what the lexicon holds.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.lexicon import Lexicon
from seqloom.runtime import distribute, local_copy

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges, as the vocabulary's makers published it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bounds of the lexicon: most words, longest word in bytes, least occurrences.
LEXICON_WORDS, WORD_BYTES, LEAST_COUNT = 100_000, 64, 2


@lru_cache(maxsize=2)
def _merger(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def merge_word(word: bytes, vocabulary: str) -> list[int]:
    """The exact merges of one word."""
    return _merger(vocabulary)._encode_single_piece(word)


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN).findall


@lru_cache(maxsize=4)
def _mapped(name: str) -> Lexicon:
    return Lexicon.map(local_copy(name))


def one_row_per_id(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text`` with each id once. Exact copies count once; of different texts under one id the largest in binary order stays.

    Only ids that occur more than once are grouped, so texts aren't shuffled where ids are unique.
    """
    rows = df.select(key, text)
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col(key).alias("_k"))
    if twice.isEmpty():
        return rows
    same = F.col(key).eqNullSafe(F.col("_k"))
    once = rows.join(twice, same, "left_anti")
    return once.unionByName(rows.join(twice, same, "left_semi").groupBy(key).agg(F.max(text).alias(text)))


def build_lexicon(docs: DataFrame, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> str:
    """Counts the words of all documents, compiles the most frequent ones and brings the automaton to the executors; returns its name."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, c = _splitter(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    c.update(split(t))
            if len(c) > 300_000:
                yield out(c)
                c.clear()
        yield out(c)

    def out(c: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in c.items() if len(w) <= WORD_BYTES]  # longer ones are always merged anew
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["w", "n"])

    counts = docs.select(text).mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    top = counts.filter((F.col("n") >= LEAST_COUNT) & (F.octet_length("w") <= WORD_BYTES)).orderBy(F.desc("n"), "w").limit(LEXICON_WORDS)
    words = [r["w"].encode() for r in top.select("w").collect()]
    lex = Lexicon.build(words, [merge_word(w, vocabulary) for w in words])
    return distribute(docs.sparkSession, lex.dump(), ".lexicon")


class Encoder:
    """Encodes batches of texts on a worker."""

    def __init__(self, name: str, vocabulary: str):
        self.lex, self.vocabulary, self.split = _mapped(name), vocabulary, _splitter()

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``offsets`` and flat ``ids`` of the texts."""
        local: dict[str, int] = {}
        put, split = local.setdefault, self.split
        which, pieces = [], np.zeros(len(texts) + 1, np.int64)
        for k, t in enumerate(texts):
            if t:
                which += [put(w, len(local)) for w in split(t)]
            pieces[k + 1] = len(which)
        words = [w.encode() for w in local]
        num = self.lex.numbers(words)
        seen = num >= 0
        lens = np.zeros(len(words), np.int64)
        lens[seen] = self.lex.off[num[seen] + 1] - self.lex.off[num[seen]]
        rest = {k: merge_word(words[k], self.vocabulary) for k in np.flatnonzero(~seen)}
        for k, ids in rest.items():
            lens[k] = len(ids)
        start = np.cumsum(lens) - lens
        table = np.zeros(int(lens.sum()), np.int32)
        table[_ragged(start[seen], lens[seen])] = self.lex.ids[_ragged(self.lex.off[num[seen]], lens[seen])]
        for k, ids in rest.items():
            table[start[k] : start[k] + len(ids)] = ids
        w = np.asarray(which, np.int64)
        out = table[_ragged(start[w], lens[w])] if len(w) else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(lens[w])]) if len(w) else np.zeros(1, np.int64)
        return ends[pieces], out


def _ragged(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start[k] .. start[k] + lens[k] - 1 of all k in a row."""
    total = int(lens.sum())
    shift = np.repeat(start - (np.cumsum(lens) - lens), lens)
    return shift + np.arange(total)


def _encoded(docs: DataFrame, key: str, text: str, vocabulary: str, lengths_only: bool, rows_at_once: int = 256) -> DataFrame:
    rows = one_row_per_id(docs, key, text)
    name = build_lexicon(rows, text, vocabulary)
    kind = dict(rows.dtypes)[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(name, vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(at, rows_at_once)
                off, ids = enc.batch(b.column(1).to_pylist())
                if lengths_only:
                    value = pa.array(np.diff(off), pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), value], names=[key, "n_tokens" if lengths_only else "ids"])

    return rows.mapInArrow(encode, f"`{key}` {kind}, " + ("n_tokens bigint" if lengths_only else "ids array<int>"))


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key, ids``: the token ids of each document without special tokens.

    One row per id (see ``one_row_per_id``); null and empty texts give an empty list, strings of special tokens are
    ordinary text, texts of any length are encoded whole. An empty table gives no rows.
    """
    return _encoded(docs, key, text, vocabulary, False)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key, n_tokens``: as ``token_ids``, but only the number of ids."""
    return _encoded(docs, key, text, vocabulary, True)
