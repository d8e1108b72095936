"""Static embeddings: mean of token vectors, unit length."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Embedder(Protocol):
    dim: int

    def __call__(self, text: str) -> np.ndarray: ...


def pooled(vectors: np.ndarray, ids: list[int], dim: int) -> np.ndarray:
    """The mean over all ids, of which unknown ones add nothing, at unit length; no id gives zeros."""
    known = [i for i in ids if 0 <= i < len(vectors)]
    if not known:
        return np.zeros(dim, np.float32)
    mean = vectors[known].sum(0) / len(ids)
    norm = float(np.sqrt((mean * mean).sum()))
    return (mean / norm if norm else mean).astype(np.float32)


class HashingEmbedder:
    """Each word is a signed unit in a bucket of its hash: no weights, the same everywhere."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def __call__(self, text: str) -> np.ndarray:
        out = np.zeros(self.dim, np.float64)
        words = re.findall(r"[^\W_]+", text.lower())
        for w in words:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = float(np.sqrt((out * out).sum()))
        return (out / norm if norm else out).astype(np.float32)


def embed(leafs: DataFrame, embedder: Embedder) -> DataFrame:
    """leafs with embedding, made in Arrow batches; the embedder travels as a broadcast."""
    shared = leafs.sparkSession.sparkContext.broadcast(embedder)
    schema = leafs.drop("embedding").schema.add("embedding", T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["embedding"] = [shared.value(x or "").tolist() for x in b["text"]]
            yield b

    return leafs.drop("embedding").mapInPandas(run, schema)
