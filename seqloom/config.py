"""Names of splits and datasets, and the figures that a prepared dataset is verified against."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from seqloom.runtime import exists

# Folder names that a split may have, the canonical one first.
SPLIT_NAMES = {"training": ("training", "train"), "evaluation": ("evaluation", "validation", "valid", "val"), "testing": ("testing", "test"), "items": ("items",)}


@dataclass(frozen=True)
class Dataset:
    """Expected size of one prepared dataset."""

    users: int
    items: int
    edges: int
    avg_len: float
    manual: bool = False


# Published sizes (users, items, edges, average length); "manual" sets must be fetched by hand.
REGISTRY = {
    "beauty": Dataset(22_363, 12_101, 114_582, 8.15),
    "sports": Dataset(35_598, 18_357, 180_610, 7.96),
    "toys": Dataset(19_412, 11_924, 102_268, 7.97),
    "cds": Dataset(75_258, 64_443, 810_347, 14.58),
    "delicious": Dataset(718, 1_200, 4_016, 9.13),
    "lastfm": Dataset(1_090, 3_646, 30_372, 34.02),
    "ml-1m": Dataset(6_040, 3_416, 268_867, 74.06),
    "yelp": Dataset(30_431, 20_033, 219_632, 10.40),
    "mind": Dataset(48_577, 39_757, 824_397, 28.16, True),
    "goodreads-comics": Dataset(89_186, 48_623, 1_282_693, 33.78),
    "goodreads-children": Dataset(163_143, 55_221, 1_622_817, 24.26),
    "steam": Dataset(334_728, 13_047, 1_524_022, 12.59),
    "hm": Dataset(1_077_045, 104_468, 19_487_762, 26.01, True),
    "amazon-m2-uk": Dataset(1_182_181, 494_409, 1_500_196, 5.12, True),
}


def resolve_datasets(names: list[str]) -> list[str]:
    """Names in the order given, without repeats; ``all`` stands for every dataset. Unknown names raise ``ValueError``."""
    out: list[str] = []
    for n in names:
        if n != "all" and n not in REGISTRY:
            raise ValueError(f"unknown dataset {n!r}; known: {', '.join(REGISTRY)}")
        out += list(REGISTRY) if n == "all" else [n]
    return list(dict.fromkeys(out))


def resolve_split(spark: SparkSession, root: str, split: str, required: bool = True) -> str | None:
    """The folder of a split below ``root``, on whichever storage, under any of its names. Unknown splits raise ``ValueError``, missing ones ``FileNotFoundError`` if required."""
    canonical = next((k for k, v in SPLIT_NAMES.items() if split in v), None)
    if canonical is None:
        raise ValueError(f"unknown split {split!r}")
    for name in SPLIT_NAMES[canonical]:
        if exists(spark, p := f"{root.rstrip('/')}/{name}", folder=True):
            return p
    if required:
        raise FileNotFoundError(f"no {canonical} split below {root}: looked for {', '.join(SPLIT_NAMES[canonical])}")
    return None


def require_files(spark: SparkSession, root: str, files: list[str], what: str, how: str = "") -> None:
    """``FileNotFoundError`` that lists what is missing."""
    lost = [f for f in files if not exists(spark, f"{root.rstrip('/')}/{f}")]
    if lost:
        raise FileNotFoundError(f"{what}: put {', '.join(lost)} into {root}. {how}".strip())
