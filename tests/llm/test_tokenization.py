import os
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from seqloom.llm.lexicon import Lexicon
from seqloom.llm.packing import SumOfSquares, pack, pack_shard
from seqloom.llm.tokenization import DEFAULT_VOCABULARY, token_counts, token_ids

needs_vocabulary = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary")


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=0, max_size=6), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_lexicon_finds_exactly_its_words(tmp_path_factory, words, others):
    words = sorted(words)
    ids = [[len(w), *w] for w in words]
    path = tmp_path_factory.mktemp("lex") / "x"
    path.write_bytes(Lexicon.build(words, ids).dump())
    lex = Lexicon.map(str(path))
    asked = words + others
    num = lex.numbers(asked)
    for w, k in zip(asked, num):
        assert (k >= 0) == (w in words)
        if k >= 0:
            assert lex.ids[lex.off[k] : lex.off[k + 1]].tolist() == [len(w), *w]


def test_suffixes_are_shared():
    words = [a + b"ation" for a in (b"cre", b"form", b"inform", b"st", b"n")]
    lex = Lexicon.build(words, [[k] for k in range(len(words))])
    assert len(lex.final) < sum(map(len, words)) // 2


@needs_vocabulary
def test_ids_against_the_public_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = [None, "", " ", "Hello  world", "<|endoftext|>x", "naïve Ünïcödé 日本語 🇪🇺‍", "a" * 5000, "tab\t\n\n end  ", "don't I'll 1234567", "\x00\x1f\x85　"]
    texts += ["".join(rng.choice("ab é日1 .,'\n") for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id long, text string, ids string")
    t = Tokenizer.from_file(os.path.join(os.path.dirname(DEFAULT_VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = {i: e.ids for i, e in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False))}
    got = token_ids(df).collect()
    assert len(got) == len(texts) and {r["doc_id"]: list(r["ids"]) for r in got} == want
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()} == {i: len(x) for i, x in want.items()}


@needs_vocabulary
def test_empty_table_and_differing_texts_of_one_id(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (None, "c")], "doc_id long, text string")
    assert {r["doc_id"]: len(r["ids"]) for r in token_ids(df).collect()} == {1: 1, None: 1}
    assert token_ids(df.limit(0)).collect() == []


def _check(sizes, capacity, rows):
    fill, parts = {}, {}
    for k, part, n, c in rows:
        fill[c] = fill.get(c, 0) + n
        parts.setdefault(k, []).append(n)
    assert max(fill.values(), default=0) <= capacity
    for k, n in sizes.items():
        assert sum(parts[k]) == n and (len(parts[k]) == 1 or n > capacity)
    return fill


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=80))
def test_packing_keeps_every_size(sizes):
    d = dict(enumerate(sizes))
    _check(d, 20, pack_shard(np.array(list(d)), np.array(sizes), 20))


def test_each_step_leaves_the_least_sum_of_squares():
    rng = random.Random(9)
    sos, levels = SumOfSquares(15), {}
    for _ in range(300):
        s = rng.randrange(1, 16)
        count = {h: list(levels.values()).count(h) for h in range(1, 15)}

        def after(g):
            c = dict(count)
            if g:
                c[g] -= 1
            if g + s < 15:
                c[g + s] += 1
            return sum(x * x for x in c.values())

        best = min(after(g) for g in [0] + [h for h in range(1, 16 - s) if h < 15 and count[h]])
        box = sos.place(s)
        levels[box] = levels.get(box, 0) + s
        assert sum(list(levels.values()).count(h) ** 2 for h in range(1, 15)) == best


def test_pack_over_shards(spark):
    rng = random.Random(10)
    sizes = {i: rng.choice([0, 5, 60, 130, 300]) for i in range(2000)}
    df = spark.createDataFrame([(k, n, 1) for k, n in sizes.items()], "doc_id long, n_tokens long, container int")
    out = [tuple(r) for r in pack(df, capacity=128, shard_containers=100).collect()]
    fill = _check(sizes, 128, out)
    assert sum(fill.values()) == sum(sizes.values())
    used = [f for f in fill.values() if f]
    assert 1 - sum(used) / (len(used) * 128) < 0.05
    assert len({c >> 32 for *_, c in out}) > 1
    assert pack(df.limit(0)).collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id long, n_tokens long")
    assert [tuple(r) for r in pack(null).collect()] == [(1, 0, 0, 0)]


def test_pack_in_a_given_order_and_with_bounded_shards(spark):
    rows = [(i, n, 100 - i) for i, n in enumerate([7, 5, 3, 9, 1, 6] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, rank long")
    for order in (None, ["rank"]):
        placed = sorted(rows, key=lambda r: r[2] if order else r[0])
        want = pack_shard([r[0] for r in placed], [r[1] for r in placed], 10)
        assert sorted(tuple(r) for r in pack(df, capacity=10, order=order).collect()) == sorted(want)
    shards = {r["container"] >> 32 for r in pack(df, capacity=10, shard_rows=8).collect()}
    assert len(shards) > 1
