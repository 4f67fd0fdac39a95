"""Item texts to vectors with a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Encodes texts into (hidden states [n, tokens, d], mask [n, tokens]).
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Sum of hidden states under the mask over max(mask sum, 1)."""
    m = mask[:, :, None].astype(hidden.dtype)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1)


def embed(items: DataFrame, key: str, text: str, load: Callable[[], Encoder], batch: int = 16) -> DataFrame:
    """``item_id, embedding``: pooled vectors of each text; null texts count as empty. ``load`` is called once per task and returns the encoder."""
    kind = dict(items.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                v = mean_pool(*encode([x or "" for x in part[text]]))
                yield pd.DataFrame({"item_id": part[key].to_numpy(), "embedding": [r.astype(np.float32) for r in v]})

    return items.select(key, text).mapInPandas(run, f"item_id {kind}, embedding array<float>")
