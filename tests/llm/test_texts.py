import io
import os
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from seqloom.llm import toxicity as tox
from seqloom.llm.encoding_repair import repair_texts
from seqloom.llm.lookalike import keys, look_classes, same_look, table, transducer, visible_forms
from seqloom.llm.segments import maximal_segments


# -- segments --------------------------------------------------------------------------------------------


def brute_segments(s):
    """Recursively: the best segment (the shortest of equal ones first), then left and right of it."""
    best = None
    for i in range(len(s)):
        t = 0
        for j in range(i, len(s)):
            t += s[j]
            if t > 0 and (best is None or t > best[0] or (t == best[0] and j - i < best[2] - best[1])):
                best = (t, i, j)
    if best is None:
        return []
    t, i, j = best
    left = brute_segments(s[:i])
    right = [(a + j + 1, b + j + 1, x) for a, b, x in brute_segments(s[j + 1 :])]
    return [*left, (i, j + 1, t), *right]


def test_known_segments():
    assert maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1, 4), (2, 3, 3), (4, 11, 7)]
    assert maximal_segments([]) == [] and maximal_segments([-1.0]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-6, 6).map(lambda x: x + 0.0), max_size=14))
def test_segments_have_the_sums_of_the_definition(s):
    got = maximal_segments(s)
    assert sorted(x for *_, x in got) == sorted(x for *_, x in brute_segments(s))
    assert all(abs(sum(s[a:b]) - x) < 1e-9 for a, b, x in got)
    assert all(p[1] <= q[0] for p, q in zip(got, got[1:]))


# -- look-alikes -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,form",
    [
        ("Ｔｈｅ　ｘ", "The x"),
        ("été", "été"),
        ("a​b⁠c﻿\xad", "abc"),
        ("Тор ѕесrеt", "Top secret"),
        ("ﬁne…", "fine..."),
        ("20 ℃ ½ m² ™", "20 °C ½ m² ™"),
        ("a\xa0  b", "a b"),
        ("co‑op", "co-op"),
        ("ＡE", "AE"),
        ("ё", "ë"),
        ("👩‍🚀", "👩‍🚀"),
        ("", ""),
        ("​ 　", ""),
        ("ｶﾞ", "ガ"),
    ],
)
def test_forms(text, form):
    assert transducer().form(text) == form


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_forms_are_stable(text):
    once = transducer().form(text)
    assert transducer().form(once) == once
    assert transducer().form(unicodedata.normalize("NFD", text)) == transducer().form(unicodedata.normalize("NFC", text))


def test_table_has_no_conflicts():
    t = table()
    assert all(c not in t or t[c] == c or c == " " for p in t.values() for c in p)
    assert not {"a", "A", "0", "é"} & set(t) - {"é"}


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.characters(), st.sampled_from("eаеԱᎪᴄ ̧́̈ \u200d\u200b　ｶﾞ👩🚀️한가ㄱㅏǃ∶")), max_size=12))
def test_automaton_agrees_with_the_rules(s):
    t = transducer()
    assert t.form(s) == " ".join(x for x in t.exact(s).split(" ") if x)


def test_longest_key_wins():
    k = keys()
    assert len(k["e\u0301"]) == 1 and k["е\u0301"] == "é"  # Latin and Cyrillic base
    assert transducer().read("e\u0301x") == "éx" and k["U\u0308\u0304"] == "Ǖ"
    assert transducer().form("ᎪᏴՕⲞᴠ∶ǃ") == "ABOOv:!"
    assert transducer().form("e\u0323\u0301") == transducer().form("e\u0301\u0323")  # in an order that no key has


def test_classes_count_their_links(spark, rows):
    data = [(1, "The é"), (2, "Тhe é"), (3, "The é"), (4, "alone"), (5, "the é"), (2, "Тhe é"), (None, "The\xa0é"), (6, None), (7, "Тhe e\u0301")]
    got = rows(look_classes(spark.createDataFrame(data, "id long, text string"), "id", "text"))
    assert got == [(1, 1, 4, 2), (2, 1, 4, 3), (3, 1, 4, 2), (7, 1, 4, 3)]


def test_a_large_class_is_spread(spark):
    df = spark.range(60).selectExpr("id", "concat('x', repeat('\u200b', int(id % 3)), 'y') AS text")
    assert same_look(df, "id", "text", per_task=7).count() == same_look(df, "id", "text").count() == 60 * 59 // 2 - 3 * (20 * 19 // 2)


def test_pairs_against_brute_force(spark, rows):
    data = [(1, "The é"), (2, "Тhe é"), (3, "The é"), (4, "The é"), (5, "the é"), (1, "The é"), (6, None), (None, "The\xa0é"), (7, ""), (8, "​"), (9, "other"), (10, "x" * 50_000), (11, "x" * 50_000 + "​")]
    df = spark.createDataFrame([(i, t, "f") for i, t in data], "id long, text string, f string")
    f = transducer().form
    clean = {(i, t) for i, t in data if i is not None and t is not None and f(t)}
    want = sorted({(a, b) for a, x in clean for b, y in clean if a < b and x != y and f(x) == f(y)})
    assert rows(same_look(df, "id", "text")) == sorted(want, key=repr)
    assert rows(same_look(df.limit(0), "id", "text")) == []
    assert visible_forms(df, "text", "f").filter("id = 6").first()["f"] is None


# -- encodings -------------------------------------------------------------------------------------------

WORDS = "Après la fête, les élèves découvrent un étrange secret. Größe fällt klein aus. Canción número siete del niño. Повесть о старом маяке и забытом письме. 静かな港町をめぐる短い物語。 Coleção de verão"


def _garble(t, wrong, right="utf-8"):
    return t.encode(right).decode(wrong, "replace" if wrong == "utf-8" else "strict")


def test_round_trip_of_wrong_encodings(spark):
    clean = [f"Title: item {i}; Text: {WORDS}" for i in range(120)]
    cases = [
        ("Après la fête, les élèves découvrent", "latin-1", "utf-8"),
        ("Größe fällt klein aus", "cp1252", "utf-8"),
        ("Canción número siete del niño", "mac_roman", "utf-8"),
        ("Größe fällt klein aus", "cp437", "utf-8"),
        ("Повесть о старом маяке и забытом письме", "cp1251", "utf-8"),
        ("Повесть о старом маяке и забытом письме", "latin-1", "cp1251"),
        ("Повесть о старом маяке и забытом письме", "koi8_r", "cp1251"),
    ]
    bad = [(1000 + i, f"Title: x; Text: {_garble(t, w, r)}", f"Title: x; Text: {t}") for i, (t, w, r) in enumerate(cases)]
    twice = _garble(_garble("Coleção de verão", "latin-1"), "latin-1")
    bad.append((2000, f"Text: {twice}", "Text: Coleção de verão"))
    lost = (3000, "Text: Cole��o de ver�o")
    rows = [(i, t) for i, t in enumerate(clean)] + [(i, t) for i, t, _ in bad] + [lost, (4000, None), (4001, ""), (4002, "plain ascii"), (4003, "Тhe ѕtory"), (4004, "x" * 30_000 + "é")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(0, clean[0], 1)], "id long, text string, k int")
    got = {r["id"]: r for r in repair_texts(df, "id", "text").collect()}
    assert 4000 not in got and len(got) == len(rows) - 1
    for i, _, want in bad:
        assert got[i]["garbled"] and got[i]["whole"] and got[i]["restored"] == want, got[i]
    assert got[3000]["garbled"] and not got[3000]["whole"]
    assert [i for i in [*range(120), 4001, 4002, 4003, 4004] if got[i]["garbled"]] == []
    assert got[5]["restored"] == clean[5]
    assert repair_texts(df.limit(0), "id", "text").collect() == []


@pytest.mark.parametrize("most", [1_000_000, 8])
def test_rare_characters_are_known(spark, monkeypatch, most):
    """Pairs beyond the bound of the table are left to the counts of their characters, which are always exact."""
    from seqloom.llm import encoding_repair as er

    seen = []
    distribute = er.distribute
    monkeypatch.setattr(er, "distribute", lambda s, data, suffix: seen.append(data) or distribute(s, data, suffix))
    monkeypatch.setattr(er, "MAX_PAIRS", most)
    df = spark.createDataFrame([(i, f"{i:04d} " + "ab" * 15_000) for i in range(100)] + [(999, "ŵy")], "id long, text string")  # 3 million pairs, one ŵ
    repair_texts(df, "id", "text")
    monkeypatch.setattr(er, "local_copy", lambda name: io.BytesIO(seen[0]))
    m = er._repairer.__wrapped__("").m
    assert (("ŵ", "y") in m.pair) == (most > 8) and len(m.pair) <= most and ("a", "b") in m.pair
    assert m.first["ŵ"] == m.second["ŵ"] == 1 and m.total == sum(m.second.values())


@pytest.mark.parametrize("most", [1, 40, 100])
def test_pairs_beyond_the_table_count_as_well(spark, monkeypatch, most):
    """The bound of the table in memory changes nothing: all other pairs are looked up."""
    from seqloom.llm import encoding_repair as er

    texts = ["Повесть о старом маяке и забытом письме", "Größe fällt klein aus", "Coleção de verão para crianças", "Une soirée d'été à Nîmes"]
    rows = [(10 * i + j, f"Title: {i}; Text: {t}") for i in range(30) for j, t in enumerate(texts)]
    rows += [(1000 + j, f"Title: x; Text: {_garble(t, r)}") for j, t in enumerate(texts) for r in ("latin-1", "cp1252") if j]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    want = sorted(map(tuple, repair_texts(df, "id", "text").collect()))
    names, seen = [], []
    real, distribute = er._rest, er.distribute
    monkeypatch.setattr(er, "distribute", lambda *a: seen.append(distribute(*a)) or seen[-1])
    monkeypatch.setattr(er, "_rest", lambda *a: names.append(real(*a)) or names[-1])
    monkeypatch.setattr(er, "MAX_PAIRS", most)
    assert sorted(map(tuple, repair_texts(df, "id", "text").collect())) == want and any(r[1] for r in want)
    counts = er.pair_counts(df.distinct(), "text").toPandas()
    full = er.PairModel(*counts[["x", "y", "n"]].to_numpy().T)
    top = counts.sort_values(["n", "x", "y"], ascending=[False, True, True])
    most = max((i for i in range(most + 1) if i == 0 or top.n.iloc[i - 1] > top.n.iloc[i]))  # pairs of one count are together
    low = top[most:].assign(k=er.pair_key(top.x.astype("int64"), top.y.astype("int64"))[most:]).sort_values("k")
    files = [np.fromfile(er.local_copy(f), "<i8").tolist() for f in names[0]]
    assert files == [low.k.tolist(), low.n.tolist()]
    assert len(er._repairer.__wrapped__(seen[0]).m.pair) == most
    part = er.PairModel(*top[:most][["x", "y", "n"]].to_numpy().T, full.first, full.second, (low.k.to_numpy(), low.n.to_numpy()))
    signs = sorted({*full.first, *full.second, "Ã", "Ð", "\xa0", "ž"})
    assert all(part.of(a, b) == full.of(a, b) for a in signs for b in signs)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_repairs_do_not_depend_on_the_table(spark, monkeypatch):
    from seqloom.llm import encoding_repair as er

    df = spark.read.parquet("/root/testdata/sf0.001/items.parquet").select("id", "text").distinct()
    want = set(map(tuple, repair_texts(df, "id", "text").collect()))
    monkeypatch.setattr(er, "MAX_PAIRS", 100)
    assert set(map(tuple, repair_texts(df, "id", "text").collect())) == want


# -- toxicity --------------------------------------------------------------------------------------------


def _corpus(n, seed):
    import random

    rng = random.Random(seed)
    fine = ["the box was intact", "it killed me when the hero died", "total garbage save your money", "a warm way to spend an evening", "delivery took days", "the villain calls him a coward"]
    bad = ["you absolute idiot nobody asked you", "go back where you came from you vermin", "i will find you and break your neck"]
    out = []
    for i in range(n):
        y = rng.random() < 0.2
        parts = [rng.choice(fine) for _ in range(rng.randrange(3, 9))]
        if y:
            parts.insert(rng.randrange(len(parts)), rng.choice(bad))
        out.append((i, ". ".join(parts) + ".", int(y)))
    return out


def test_held_out_accuracy_and_spelling_tricks():
    train = _corpus(800, 1)
    m = tox.fit([t for _, t, _ in train], [y if i % 25 else 1 - y for i, (_, _, y) in enumerate(train)])  # 4 percent wrong labels
    test = _corpus(400, 2)
    hits = [(m.passages(t)[0] >= m.cut, bool(y)) for _, t, y in test]
    assert sum(a == b for a, b in hits) >= 396
    for odd in ("you absolute 1d10t nobody asked you", "you absolute i.d.i.o.t nobody asked you", "you absolute idiooooot nobody asked you", "you absolute id​iot nobody asked you", "YOU ABSOLUTE ІDІОT NOBODY ASKED YOU"):
        assert m.passages(f"The box was intact. {odd}. Delivery took days.")[0] >= m.cut, odd


def test_cut_follows_the_shares_of_all_labels(spark, monkeypatch):
    monkeypatch.setattr(tox, "FIT_POSITIVES", 60)
    monkeypatch.setattr(tox, "FIT_NEGATIVES", 90)
    train = _corpus(1500, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in train], "doc_id long, annotator int, toxic int")
    rows = tox.labelled_sample(docs, labels).collect()
    assert sum(r["y"] for r in rows) == 60 and len(rows) == 150
    assert abs(sum(r["w"] * r["y"] for r in rows) / sum(r["w"] for r in rows) - sum(y for *_, y in train) / 1500) < 1e-9
    # 40 sure texts, then 28 of which more than half are positive in the sample, but few in the whole
    sig, y = np.arange(148.0, 0, -1), np.array([1] * 40 + [0, 1, 1, 1] * 7 + [0] * 80)
    assert tox.best_cut(sig, y, np.ones(148)) == 80.5 and tox.best_cut(sig, y, np.where(y == 1, 0.1, 1.5)) == 108.5


def test_rows_without_id_count_by_their_text(spark):
    docs = spark.createDataFrame([(None, "s", "a box"), (None, "s", "a book"), (None, "s", "a book"), (1, "s", "a box")], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, annotator int, toxic int")
    assert tox.toxicity(docs, labels).count() == 3


def test_words():
    assert tox.words("Don't g o o d b y e n.u.d.e!") == ["don't", "goodbye", "nude", "!"]
    assert tox.words("") == [] and tox.plain("h0rr1bl3") == "horible"


def test_frames_with_nulls_and_without_labels(spark):
    train = _corpus(300, 3)
    docs = spark.createDataFrame([(i, t, "s" if i % 3 else None, 1) for i, t, _ in train] + [(900, None, "s", 1), (901, "", "s", 1), (902, " ", None, 1), (903, "fine. " * 30_000, "s", 1)], "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame([(i, a, y) for i, _, y in train for a in (1, 2)] + [(0, 3, None), (None, 1, 1), (5000, 1, 1)], "doc_id long, annotator int, toxic int")
    got = {r["doc_id"]: r for r in tox.toxicity(docs, labels).collect()}
    assert sum(got[i]["toxic"] == bool(y) for i, _, y in train) >= 296
    for i in (900, 901, 902):
        assert not got[i]["toxic"] and got[i]["score"] == 0 and got[i]["passage"] is None
    assert not got[903]["toxic"]
    none = tox.toxicity(docs, labels.limit(0))
    assert none.filter("toxic").count() == 0 and none.count() == docs.count()
    assert tox.toxicity(docs.limit(0), labels).collect() == []
