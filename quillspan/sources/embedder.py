"""Embedding of texts through a pluggable model."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(ABC):
    """``prepare`` loads the model once per worker, ``embed`` turns texts into vectors."""

    @abstractmethod
    def prepare(self) -> None: ...

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray: ...


def embedded(rows: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """Rows with the unit vectors of their texts; a null text has none."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder.prepare()
        for texts in batches:
            made = pd.Series([None] * len(texts), dtype=object)
            there = texts.notna().to_numpy()
            if there.any():
                v = np.asarray(embedder.embed(texts[there].tolist()), np.float32)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                made[np.flatnonzero(there)] = list(v / np.where(n > 0, n, 1))
            yield made

    return rows.withColumn(out, run(F.col(text)))


def precomputed(rows: DataFrame, vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Rows with vectors from a table, matched by key; rows without one keep a null."""
    return rows.join(vectors.select(key, vector), key, "left")
