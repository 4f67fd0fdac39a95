"""The preparation plans on tiny generated dumps."""

import json

from seqloom.plans import prepare


def _tags(tmp_path, packed):
    head = "u\tb\tt\t" + ("d\tm\ty\th\tn\ts" if packed else "ms")
    lines = [head]
    for u in range(5):
        for i in range(5):
            when = f"{i + 1}\t1\t2010\t0\t0\t{u}" if packed else str(100 * i + u)
            lines.append(f"u{u}\ti{i}\t{7 if i else 8}\t{when}")
    lines.append("u9\ti0\t7\t" + ("1\t1\t2010\t0\t0\t0" if packed else "5"))
    (tmp_path / "e.dat").write_text("\n".join(lines) + "\n")
    (tmp_path / "i.dat").write_text("id\tx\tt\n" + "".join(f"i{i}\tName {i}\tTitle {i}\n" for i in range(4)))
    (tmp_path / "t.dat").write_text("id\tname\n7\trock\n8\tpop\n")
    return [str(tmp_path / x) for x in ("e.dat", "i.dat", "t.dat")]


def test_packed_tags(spark, tmp_path):
    seqs, text = prepare.packed_tags(spark, *_tags(tmp_path, True))
    assert {r["user_key"]: r["seq"] for r in seqs.collect()} == {f"u{u}": [f"i{i}" for i in range(5)] for u in range(5)}
    t = dict(map(tuple, text.collect()))
    assert t["i1"] == "Title: Title 1; Tags: rock" and t["i0"] == "Title: Title 0; Tags: pop, rock"  # the raw log counts, u9 included
    assert t["i4"] == "Tags: rock"


def test_millisecond_tags(spark, tmp_path):
    seqs, text = prepare.millisecond_tags(spark, *_tags(tmp_path, False))
    assert {r["user_key"] for r in seqs.collect()} == {f"u{u}" for u in range(5)}
    assert dict(map(tuple, text.collect()))["i1"] == "Artist: Name 1; Tags: rock"


def test_rated_movies(spark, tmp_path):
    (tmp_path / "r.dat").write_bytes("".join(f"{u}::{m}::{m % 5 + 1}::{m * 10}\n" for u in range(5) for m in range(4)).encode("latin-1"))
    (tmp_path / "m.dat").write_bytes("0::Amélie (2001)::Comedy|Romance\n1::B::Drama\n".encode("latin-1"))
    seqs, text = prepare.rated_movies(spark, str(tmp_path / "r.dat"), str(tmp_path / "m.dat"))
    assert [r["seq"] for r in seqs.collect()] == [["0", "1", "2", "3"]] * 5
    t = dict(map(tuple, text.collect()))
    assert t["0"] == "Title: Amelie (2001); Genres: Comedy, Romance" and t["3"] == "Movie 3"


def test_rated_books(spark, tmp_path):
    def dump(name, rows):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        return str(tmp_path / name)

    day = "Tue Nov {:02d} 11:37:35 -0800 2015"
    log = [{"user_id": f"u{u}", "book_id": str(b), "rating": 5 if b < 5 else 3, "date_added": day.format(b + 1)} for u in range(5) for b in range(6)]
    log.append({"user_id": "u0", "book_id": "0", "rating": 5, "date_added": "bad"})
    books = [{"book_id": str(b), "title": f"T{b}", "authors": [{"author_id": "2"}, {"author_id": "1"}], "publisher": "", "publication_year": "1999", "description": None} for b in range(6)]
    authors = [{"author_id": "1", "name": "Ann"}, {"author_id": "2", "name": "Bo"}]
    seqs, text = prepare.rated_books(spark, dump("i.json", log), dump("b.json", books), dump("a.json", authors))
    assert [r["seq"] for r in seqs.collect()] == [["0", "1", "2", "3", "4"]] * 5
    assert dict(map(tuple, text.collect()))["0"] == "Title: T0; Authors: Bo, Ann; Year: 1999"


def test_game_reviews(spark, tmp_path):
    (tmp_path / "g.txt").write_text("".join(repr({"id": str(g), "app_name": f"G{g}", "genres": ["A", "B"]}) + "\n" for g in range(5)))
    (tmp_path / "r.txt").write_text("".join(json.dumps({"product_id": str(g), "username": f"u{u}", "date": f"2018-{g + 1}-4"}) + "\n" for u in range(5) for g in range(5)) + "broken\n")
    seqs, text = prepare.game_reviews(spark, str(tmp_path / "g.txt"), str(tmp_path / "r.txt"))
    assert [r["seq"] for r in seqs.collect()] == [["0", "1", "2", "3", "4"]] * 5
    assert dict(map(tuple, text.collect()))["0"] == "Title: G0; Genres: A, B"


def test_literal_reviews_and_given_sequences(spark, tmp_path):
    (tmp_path / "r.txt").write_text("".join(repr({"reviewerID": "u", "asin": a, "unixReviewTime": t, "x": True}) + "\n" for a, t in (("b", 2), ("a", 1), ("c", 3))))
    (tmp_path / "m.txt").write_text(repr({"asin": "a", "title": "First", "categories": [["Music", "Rock"]]}) + "\n" + repr({"asin": "a", "title": "Second"}) + "\n")
    seqs, text = prepare.literal_reviews(spark, str(tmp_path / "r.txt"), str(tmp_path / "m.txt"))
    assert [tuple(r) for r in seqs.collect()] == [("u", ["a", "b", "c"])]
    assert dict(map(tuple, text.collect())) == {"a": "Title: First; Categories: ['Music', 'Rock'];", "b": "ASIN: b", "c": "ASIN: c"}
    (tmp_path / "u.json").write_text(json.dumps({"2": [5, 6, 7], "1": [5]}))
    (tmp_path / "i.json").write_text(json.dumps({"5": {"title": "Café", "description": "Food"}}))
    seqs, text = prepare.given_sequences(spark, str(tmp_path / "u.json"), str(tmp_path / "i.json"))
    assert [tuple(r) for r in seqs.collect()] == [(2, [5, 6, 7])]
    assert dict(map(tuple, text.collect())) == {5: "Title: Cafe; Categories: Food", 6: "Item: 6", 7: "Item: 7"}
