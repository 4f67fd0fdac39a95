import gzip
import json
import struct

import pytest

from seqloom import config
from seqloom.operators import embed, sinks
from seqloom.plans import prepare
from seqloom.sources import readers as rd
from seqloom.sources import tfrecord


def _varint(n):
    out = b""
    n &= (1 << 64) - 1
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(k, data):
    return bytes([k << 3 | 2]) + _varint(len(data)) + data


def _example(features):
    entries = b""
    for name, values in features.items():
        if isinstance(values[0], bytes):
            f = _field(1, b"".join(_field(1, v) for v in values))
        else:
            f = _field(3, _field(1, b"".join(map(_varint, values))))
        entries += _field(1, _field(1, name.encode()) + _field(2, f))
    return _field(1, entries)


def _write(path, examples):
    with gzip.open(path, "wb") as f:
        for e in examples:
            f.write(struct.pack("<Q", len(e)) + b"\0" * 4 + e + b"\0" * 4)


def test_tfrecord_source(spark, tmp_path, rows):
    _write(tmp_path / "data_0.tfrecord.gz", [_example({"user_id": [7], "sequence_data": [1, 300, -5]}), _example({"user_id": [8]})])
    _write(tmp_path / "data_1.tfrecord.gz", [_example({"id": [1], "text": ["é".encode() + b"\xff"]})])
    tfrecord.register(spark)
    df = spark.read.format("tfrecord").schema("user_id bigint, sequence_data array<bigint>").load(str(tmp_path / "data_0*"))
    assert rows(df) == [(7, [1, 300, -5]), (8, [])]
    df = spark.read.format("tfrecord").schema("id bigint, text string").load(str(tmp_path / "data_1*"))
    assert rows(df) == [(1, "é�")]


def test_tags_and_keys(spark, tmp_path, rows):
    p = tmp_path / "t.dat"
    p.write_text("u\tb\tt\td\tm\ty\th\tn\ts\n1\t2\t9\t3\t11\t2010\t4\t5\t6\n1\t2\t8\t1\t1\t2009\t0\t0\t0\n1\t3\t\tx\t1\t2009\t0\t0\t0\nshort\n")
    e = rd.tagged_events(spark, str(p), packed=True)
    assert rows(e.select("user", "item", "tag", "ts")) == [("1", "2", "8", 20090101000000), ("1", "2", "9", 20101103040506), ("1", "3", None, 0)]
    assert rows(rd.first_tagging(e).select("user", "item", "ts")) == [("1", "2", 20101103040506), ("1", "3", 0)]
    q = tmp_path / "m.dat"
    q.write_text("u\ta\tt\tms\n1\t2\t9\t50\n1\t2\t8\t40\n1\t2\t8\tbad\n")
    assert rows(rd.earliest_tagging(rd.tagged_events(spark, str(q), packed=False)).select("user", "item", "ts")) == [("1", "2", 40)]
    k = tmp_path / "k.dat"
    k.write_text("id\tx\tname\n1\ta\tA\n1\tb\tB\n2\n")
    assert rows(rd.key_columns(spark, str(k), 0, [2])) == [("1", "B")]


def test_other_readers(spark, tmp_path, rows):
    r = tmp_path / "ratings.dat"
    r.write_bytes("1::10::5::100\n1::x\n2::11::bad::7\n3::é::4::9\n".encode("latin-1"))
    assert rows(rd.ratings(spark, str(r)).drop("ord")) == [("1", "10", 5, 100), ("3", "é", 4, 9)]
    o = tmp_path / "o.txt"
    o.write_text("{'id': '1', 'x': True}\n{\"id\": \"2\"}\nbroken\n")
    assert rows(rd.object_lines(spark, str(o), "id string").drop("ord")) == [("1",), ("2",)]
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"5": [1, 2]}))
    assert rows(rd.object_map(spark, str(m), "array<bigint>")) == [("5", [1, 2])]
    c = tmp_path / "c.csv"
    c.write_text('id,t,z\n007,"a ""q"", b",1\n008,,2\n')
    assert rows(rd.csv_columns(spark, str(c), ["id", "t"]).drop("ord")) == [("007", 'a "q", b'), ("008", "")]
    t = tmp_path / "n.tsv"
    t.write_text('N1\ta\tb\t"x ""y"""\n')
    assert rows(rd.quoted_tsv(spark, str(t), ["id", "b", "c", "title"]).drop("ord")) == [("N1", "a", "b", 'x "y"')]


def test_names_and_folders(spark, tmp_path):
    assert config.resolve_datasets(["hm", "all", "hm"])[0] == "hm" and len(config.resolve_datasets(["all"])) == len(config.REGISTRY)
    with pytest.raises(ValueError):
        config.resolve_datasets(["nope"])
    (tmp_path / "val").mkdir()
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert config.resolve_split(spark, root, "evaluation").endswith("val")
        assert config.resolve_split(spark, root, "items", required=False) is None
    with pytest.raises(FileNotFoundError):
        config.resolve_split(spark, str(tmp_path), "testing")
    with pytest.raises(ValueError):
        config.resolve_split(spark, str(tmp_path), "other")
    with pytest.raises(FileNotFoundError):
        config.require_files(spark, str(tmp_path), ["a.csv"], "x")


def test_tfrecord_round_trip(spark, tmp_path, rows):
    tfrecord.register(spark)
    data = [(7, [1, 300, -5], ["é", ""], 0.5), (-1, [], [], None), (9, [0], ["x" * 1000], -2.0)]
    kind = "user_id bigint, sequence_data array<bigint>, text array<string>, w float"
    df = spark.createDataFrame(data, kind).repartition(2)
    df.write.format("tfrecord").mode("append").save(str(tmp_path / "o"))
    assert all(p.name.endswith(".tfrecord.gz") for p in (tmp_path / "o").iterdir())
    assert rows(spark.read.format("tfrecord").schema(kind).load(str(tmp_path / "o"))) == sorted(data, key=repr)
    df.limit(1).write.format("tfrecord").mode("overwrite").save(f"file://{tmp_path}/o")
    assert spark.read.format("tfrecord").schema(kind).load(f"file://{tmp_path}/o").count() == 1
    assert tfrecord.masked_crc(b"") == 0xA282EAD8 and tfrecord.crc32c(b"123456789") == 0xE3069283
    broken = bytearray(b"".join(tfrecord.framed(b"abc")))
    broken[-5] ^= 1
    (tmp_path / "b.tfrecord").write_bytes(bytes(broken))
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("tfrecord").schema(kind).option("verify", "true").load(str(tmp_path / "b.tfrecord")).collect()


def test_order_follows_the_files(spark, tmp_path):
    """The larger file comes second by name, and is still read second."""
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text('{"id": "1"}\n{"id": "2"}\n')
    (tmp_path / "d/b.txt").write_text("".join('{"id": "%d"}\n' % i for i in range(3, 400)))
    for read in (rd.json_lines, rd.object_lines):
        assert [int(r["id"]) for r in read(spark, str(tmp_path / "d"), "id string").orderBy("ord").collect()] == list(range(1, 400))


def test_literals_with_json_constants():
    from seqloom.functions.text import parse_object

    assert parse_object("{'a': true, 'b': 'true', 'c': \"it's null\", 'd': null}") == {"a": True, "b": "true", "c": "it's null", "d": None}
    assert parse_object("[1]") is None and parse_object("{'a': tru}") is None


def test_list_literals(spark):
    from seqloom.functions.text import list_literal

    data = [["A", "B's"], ['say "x"'], ["both ' and \""], ["back\\slash", "new\nline"], [], ["é"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x array<string>")
    assert [r["l"] for r in df.orderBy("i").select(list_literal(df["x"]).alias("l")).collect()] == [repr(x) for x in data]


def test_session_plan_and_dataset_writer(spark, tmp_path, rows):
    (tmp_path / "p.csv").write_text("id,locale,title,brand,color,material,desc\nA,UK,Tea,,,,\nA,UK,Other,,,,\nB,UK,Cup,Bo,,,\nC,DE,Tasse,,,,\nD,UK,,,,,\n")
    (tmp_path / "s.csv").write_text("prev_items,next_item,locale\n\"['A' 'B']\",A,UK\n\"['A' 'D']\",B,UK\n\"['C' 'C']\",C,DE\n")
    seqs, text = prepare.sessions(spark, str(tmp_path / "p.csv"), str(tmp_path / "s.csv"))
    assert [r["seq"] for r in seqs.collect()] == [["A", "B", "A"]]
    assert rows(text) == [("A", "Title: Tea"), ("B", "Title: Cup; Brand: Bo")]
    out = str(tmp_path / "out")
    stats = sinks.write_dataset(out, seqs, text, user_parts=2, item_parts=2, with_text=True).first()
    assert (stats["n_users"], stats["n_items"], stats["n_interactions"]) == (1, 2, 3)
    for split, want in (("training", [0]), ("evaluation", [0, 1]), ("testing", [0, 1, 0])):
        r = spark.read.parquet(f"{out}/{split}").first()
        assert r["sequence_data"] == want and len(r["text"]) == len(want)
    assert rows(spark.read.parquet(f"{out}/items")) == [(0, "Title: Tea"), (1, "Title: Cup; Brand: Bo")]
    with pytest.raises(KeyError):
        sinks.write_dataset(out + "2", seqs, text.filter("item_key = 'A'"))


def test_news_and_transaction_plans(spark, tmp_path, rows):
    (tmp_path / "n.tsv").write_text("".join(f"N{i}\tc\ts\ttitle {i}\n" for i in range(5)))
    (tmp_path / "b.tsv").write_text("1\tU1\t11/15/2019 9:00:00 AM\tN0 N1\tN2-1 N3-0\n2\tU1\t11/15/2019 8:00:00 AM\tN9\tN4-1 N0-1\n")
    seqs, _ = prepare.news(spark, [str(tmp_path / "n.tsv")], str(tmp_path / "b.tsv"))
    assert rows(seqs) == [("U1", ["N0", "N1", "N4", "N2"])]
    (tmp_path / "a.csv").write_text("article_id,prod_name,product_type_name,product_group_name,colour_group_name,department_name,detail_desc\n01,Hat,,,,,\n02,Sock,,,,,\n03,,,,,,\n")
    (tmp_path / "t.csv").write_text("t_dat,customer_id,article_id\n2020-01-02,c,02\n2020-01-01,c,01\n2020-01-01,c,03\n2020-01-01,c,01\n2020-01-03,c,01\n")
    seqs, _ = prepare.transactions(spark, str(tmp_path / "a.csv"), str(tmp_path / "t.csv"))
    assert rows(seqs) == [("c", ["01", "02", "01"])]


def test_shards_embeddings_and_graph_writers(spark, tmp_path, rows):
    ids = spark.range(10).withColumnRenamed("id", "i")
    assert {r["i"]: r["shard"] for r in sinks.shard_numbers(ids, "i", 4).collect()} == {i: i // 3 for i in range(10)}
    v = spark.createDataFrame([(1, [1.0]), (1, [0.5]), (2, None)], "item long, e array<double>")
    sinks.write_embeddings(v, "item", "e", str(tmp_path / "e"))
    assert rows(spark.read.parquet(str(tmp_path / "e"))) == [(1, [0.5])]
    sinks.write_graph(spark.createDataFrame([(1, 2, 3)], "src long, dst long, cnt long"), str(tmp_path / "g"))
    assert rows(spark.read.parquet(str(tmp_path / "g"))) == [(1, 2, 3)]


def test_encoder_adapter(spark):
    import numpy as np

    def load():
        def encode(texts):
            n = max([len(t) for t in texts] + [1])
            h = np.array([[[float(ord(c))] for c in t.ljust(n)] for t in texts])
            return h, np.array([[i < len(t) for i in range(n)] for t in texts])

        return encode

    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    assert {r["item_id"]: r["embedding"] for r in embed.embed(df, "id", "text", load).collect()} == {1: [97.5], 2: [0.0]}


def test_stream_shards(spark, tmp_path, rows):
    from seqloom.operators import graph
    from seqloom.streaming.transitions import append_shards

    src = tmp_path / "in"
    spark.createDataFrame([([1, 2, 3, 4],), ([1, 2, 5, 5],)], "seq array<long>").write.parquet(str(src))
    q = append_shards(spark.readStream.schema("seq array<long>").parquet(str(src)), "seq", str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(graph.from_shards(got.select("shard", "src", "dst", "cnt"), "src", "dst", "cnt")) == [(1, 2, 2)]
