"""Vectors of texts: a pluggable model behind one Arrow function.

`hashed` is a deterministic stand-in (signed character n-grams), for tests and for running without a
model; its similarities are not those of a trained model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def hashed(dim: int = 64, n: int = 3) -> Callable[[list[str]], np.ndarray]:
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            padded = f" {t.lower()} "
            for k in range(len(padded) - n + 1):
                h = crc32(padded[k : k + n].encode())
                out[i, h % dim] += 1.0 if h >> 16 & 1 else -1.0
        return out

    return embed


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


def vectors(text: Column, model: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "") -> Column:
    """Unit vectors of a text column; the model is made once in each worker, null texts have null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = model()
        for texts in batches:
            known = [t for t in texts if t is not None]
            rows = iter(unit(np.asarray(embed([prefix + t for t in known]), np.float32)) if known else ())
            yield pd.Series([None if t is None else next(rows) for t in texts], index=texts.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)
