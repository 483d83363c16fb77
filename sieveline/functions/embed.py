"""Embedders. The default one needs no model: words hash to signed components of a unit vector."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIMENSIONS = 384
BATCH = 64
_WORD = re.compile("[a-z0-9]+")


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimensions)
            words = [p for w in re.findall("[A-Za-z0-9]+", text) for p in (*_WORD.findall(re.sub("([a-z0-9])([A-Z])", r"\1 \2", w).lower()), w.lower())]
            for w in words:
                h = zlib.crc32(w.encode())
                v[h % self.dimensions] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out


BACKENDS = {"hashing": HashingEmbedder}


def backend(name: str = "auto", **options) -> Embedder:
    chosen = "hashing" if name == "auto" else name
    if chosen not in BACKENDS:
        raise ValueError(f"unknown embedder {name!r}; known: auto, {', '.join(sorted(BACKENDS))}")
    return BACKENDS[chosen](**options)


def embed_column(text: Column, embedder: Embedder, batch: int = BATCH) -> Column:
    """Vectors of a text column, in Arrow batches."""

    @F.pandas_udf(ArrayType(FloatType(), False))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in embedder.embed(texts[i : i + batch])])

    return run(text)
