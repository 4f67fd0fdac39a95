"""python -m seqloom prepare | embed | graph | recommend | verify: the stages over Parquet folders."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import sys

from pyspark.sql import SparkSession

from seqloom import config
from seqloom.operators import metrics, sinks
from seqloom.plans import prepare as plans
from seqloom.plans import recommend as rec
from seqloom.plans import stages
from seqloom.runtime import ensure_checkpoint_dir

#: Fields of ``Config`` and the option each is known by; the defaults are those of ``Config``.
OPTIONS = {"budgets": "hop_k", "budgets2": "src2_hop_k", "budgets3": "src3_hop_k", "alpha": "edge_weight_alpha", "explicit_depth": "max_explicit_depth"}


def add_config(p: argparse.ArgumentParser) -> None:
    for f in dataclasses.fields(rec.Config):
        name = f"--{OPTIONS.get(f.name, f.name)}"
        if isinstance(f.default, bool):
            p.add_argument(name, dest=f.name, action="store_true")
        elif isinstance(f.default, tuple):
            p.add_argument(name, dest=f.name, type=int, nargs="*" if f.name == "budgets3" else "+", default=f.default)
        else:
            p.add_argument(name, dest=f.name, type=type(f.default), default=f.default)


def read_config(args: argparse.Namespace) -> rec.Config:
    values = {f.name: getattr(args, f.name) for f in dataclasses.fields(rec.Config)}
    return rec.Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("prepare", help="raw files to items, splits and id maps")
    a.add_argument("dataset", choices=list(plans.PLANS))
    a.add_argument("out")
    a.add_argument("inputs", nargs="+")
    a.add_argument("--cache", help="folder that keeps the raw sequences between runs")
    a.add_argument("--format", choices=["parquet", "tfrecord"], default="parquet")
    a = sub.add_parser("embed", help="item texts to vectors")
    a.add_argument("data", nargs="+")
    a.add_argument("--encoder", required=True, help="module:function that returns an encoder")
    a.add_argument("--batch_size", type=int, default=8)
    a.add_argument("--overwrite", action="store_true")
    a = sub.add_parser("graph", help="training splits to transition counts")
    a.add_argument("data", nargs="+")
    a.add_argument("--overwrite", action="store_true")
    a = sub.add_parser("recommend", help="test split, graph and vectors to lists and metrics")
    a.add_argument("data")
    a.add_argument("embeddings", nargs="?", help="by default the folder embeddings below data")
    a.add_argument("--method", choices=["single", "two"], default="single")
    add_config(a)
    a = sub.add_parser("verify", help="sizes against the registry")
    a.add_argument("root", help="folder with a folder for each dataset")
    a.add_argument("datasets", nargs="*", default=["all"])
    a.add_argument("--quick", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqloom").getOrCreate()
    ensure_checkpoint_dir(spark)
    if args.command == "prepare":
        if config.REGISTRY[args.dataset].manual:
            for f in args.inputs:
                config.require_files(spark, f.rpartition("/")[0] or ".", [f.rpartition("/")[2]], args.dataset)
        inputs = [args.inputs[:-1], args.inputs[-1]] if args.dataset == "mind" else args.inputs
        seqs, text = plans.PLANS[args.dataset](spark, *inputs)
        seqs = stages.cached(spark, args.cache and f"{args.cache.rstrip('/')}/{args.dataset}_sequences", lambda: seqs)
        sinks.write_dataset(args.out, seqs, text, fmt=args.format).show()
        return 0
    if args.command == "embed":
        module, _, name = args.encoder.partition(":")
        for d in stages.embed_items(spark, args.data, getattr(importlib.import_module(module), name), args.batch_size, args.overwrite):
            print(f"{d}: embedded")
        return 0
    if args.command == "graph":
        for d in args.data:
            print(f"{d}: {stages.load_graph(spark, d, args.overwrite).count()} edges")
        return 0
    if args.command == "verify":
        rows = [(n, *stages.check(spark, f"{args.root.rstrip('/')}/{n}", n, args.quick)) for n in config.resolve_datasets(args.datasets)]
        for name, status, note in rows:
            print(f"{status:<11}{name}  {note}")
        return int(any(s in ("MISMATCH", "INCOMPLETE") for _, s, _ in rows))
    seqs = stages.load_split(spark, args.data, "testing").selectExpr("user_id", "sequence_data AS seq")
    edges = stages.load_graph(spark, args.data)
    vectors = rec.unit_vectors(spark.read.parquet(args.embeddings or f"{args.data}/embeddings"), "item_id", "embedding")
    cfg = read_config(args)
    out = (rec.single_source if args.method == "single" else rec.two_source)(seqs, edges, vectors, cfg)
    rec.predictions(out, cfg.top_k).write.mode("overwrite").parquet(f"{args.data}/predictions_{args.method}")
    metrics.ranking_metrics(out, "items", "target").orderBy("k").show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
