"""The command line over a small prepared folder."""

import pytest

from seqloom import __main__ as cli
from seqloom import config
from seqloom.operators import sinks
from seqloom.plans import recommend as rec
from seqloom.plans import stages


def encoder():
    import numpy as np

    return lambda texts: (np.array([[[float(len(t)), 1.0]] for t in texts]), np.ones((len(texts), 1)))


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    seqs = spark.createDataFrame([(u, [f"i{(u + k) % 9}" for k in range(4 + u % 3)]) for u in range(12)], "user_key long, seq array<string>")
    text = spark.createDataFrame([(f"i{k}", "x" * k) for k in range(9)], "item_key string, text string")
    sinks.write_dataset(str(root / "lastfm"), seqs, text, user_parts=3, item_parts=2).collect()
    return root


def test_options_follow_the_config():
    cfg = cli.read_config(cli.parser().parse_args(["recommend", "d"]))
    assert cfg == rec.Config()
    cfg = cli.read_config(cli.parser().parse_args(["recommend", "d", "e", "--hop_k", "4", "1", "--max_explicit_depth", "1", "--semantic_pad", "--src3_hop_k"]))
    assert (cfg.budgets, cfg.explicit_depth, cfg.semantic_pad, cfg.budgets3) == ((4, 1), 1, True, ())


def test_stages_from_prepared_to_lists(spark, prepared, capsys, monkeypatch):
    d = str(prepared / "lastfm")
    assert stages.check(spark, str(prepared / "hm"), "hm") == ("MISSING", "not prepared")
    assert stages.check(spark, d, "lastfm", quick=True) == ("PRESENT", "no embeddings; no graph")
    (prepared / "steam/train").mkdir(parents=True)
    assert stages.check(spark, str(prepared / "steam"), "steam") == ("INCOMPLETE", "no evaluation, testing, items")
    monkeypatch.setattr(spark, "stop", lambda: None)
    assert cli.main(["embed", d, "--encoder", "tests.test_stages:encoder"]) == 0
    assert {r["item_id"]: r["embedding"] for r in spark.read.parquet(f"{d}/embeddings").collect()} == {k: [float(k), 1.0] for k in range(9)}
    assert stages.embed_items(spark, [d, str(prepared / "none")], encoder) == []
    assert cli.main(["recommend", d, "--method", "two", "--max_explicit_depth", "1"]) == 0  # builds the graph
    got = spark.read.parquet(f"{d}/predictions_two")
    assert got.count() == 12 and {len(set(r["item_ids"])) for r in got.collect()} == {9}  # all that there are
    assert cli.main(["graph", d]) == 0
    monkeypatch.setitem(config.REGISTRY, "lastfm", config.Dataset(12, 9, spark.read.parquet(f"{d}/graph").count(), 5.0))
    assert stages.check(spark, d, "lastfm") == ("OK", "")
    assert cli.main(["verify", str(prepared), "lastfm", "hm"]) == 0
    monkeypatch.setitem(config.REGISTRY, "lastfm", config.Dataset(13, 9, 1, 5.0))
    assert stages.check(spark, d, "lastfm")[0] == "MISMATCH" and cli.main(["verify", str(prepared), "all", "--quick"]) == 1
    assert "MISSING    hm" in capsys.readouterr().out


def test_cached_frames_are_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert stages.cached(spark, str(tmp_path / "c"), build).count() == 3
    assert built == [1] and stages.cached(spark, None, build).count() == 3


def test_dataset_as_tfrecords(spark, tmp_path):
    from seqloom.sources import tfrecord

    seqs = spark.createDataFrame([(1, ["a", "b", "a"])], "user_key long, seq array<string>")
    text = spark.createDataFrame([("a", "A"), ("b", "B")], "item_key string, text string")
    sinks.write_dataset(str(tmp_path / "o"), seqs, text, user_parts=2, item_parts=2, fmt="tfrecord").collect()
    tfrecord.register(spark)
    assert [tuple(r) for r in spark.read.format("tfrecord").load(str(tmp_path / "o/evaluation")).collect()] == [(0, [0, 1])]
    assert sorted(tuple(r) for r in spark.read.format("tfrecord").schema("id bigint, text string").load(str(tmp_path / "o/items")).collect()) == [(0, "A"), (1, "B")]
    with pytest.raises(FileExistsError):
        sinks.write_dataset(str(tmp_path / "o"), seqs, text, fmt="tfrecord")
