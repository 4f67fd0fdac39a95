import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from seqloom.functions import text as tx


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def ws(s):
    for m in tx.LINE_MARKS:
        s = s.replace(m, " ")
    return s.strip()


def test_clean(spark):
    odd = [None, "", "  a\t b\n", " x　", "\x1cq\x1f", "a b", "“x”–…", "ﬁne café №", "Ǻ"]
    df = spark.createDataFrame([(x,) for x in odd], "x string").select("x", tx.clean_ws(F.col("x")).alias("w"), tx.clean_ascii(F.col("x")).alias("a"))
    for r in df.collect():
        w = ws(r["x"] or "")
        assert r["w"] == w
        t = w.translate(str.maketrans(tx.TYPOGRAPHY))
        assert r["a"] == unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()


def test_fields_lists_and_impressions(spark):
    df = spark.createDataFrame([("T", " ", None)], "a string, b string, c string")
    assert df.select(tx.join_fields([("A", F.col("a")), ("B", F.col("b")), ("C", F.col("c"))])).first()[0] == "A: T"
    assert _one(spark, "Title: X; Brand: Y", lambda c: tx.field_value(c, "Brand")) == "Y"
    assert _one(spark, "['A' 'B'\n 'C']", tx.bracket_list) == ["A", "B", "C"]
    assert _one(spark, None, tx.bracket_list) == []
    assert [tuple(x) for x in _one(spark, "N1-0 a-b-1 x", tx.impressions)] == [("N1", "0"), ("a-b", "1")]


def test_dates(spark):
    assert str(_one(spark, "Tue Nov 17 11:37:35 -0800 2015", tx.parse_long_date)) == "2015-11-17 19:37:35"
    assert str(_one(spark, "11/5/2019 9:07:00 PM", tx.parse_us_date)) == "2019-11-05 21:07:00"
    assert str(_one(spark, "2018-3-4", tx.parse_iso_date)) == "2018-03-04 00:00:00"
    for f in (tx.parse_long_date, tx.parse_us_date, tx.parse_iso_date):
        assert _one(spark, "nonsense", f) is None and _one(spark, None, f) is None


def test_objects():
    assert tx.parse_object('{"a": true}') == {"a": True}
    assert tx.parse_object("{'a': True, 'b': u'x'}") == {"a": True, "b": "x"}
    assert tx.parse_object("{'a': ") is None and tx.parse_object("[1]") is None


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.integers() | st.text(max_size=5) | st.booleans(), max_size=4))
def test_objects_round_trip(d):
    assert tx.parse_object(repr(d)) == d
