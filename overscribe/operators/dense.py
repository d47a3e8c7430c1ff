"""Vectors: pluggable embedding and reranking, and exact nearest neighbours.

No model is at hand offline. HashedEmbedder and LexicalReranker stand in:
deterministic, and not comparable in quality with what they stand for.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import blocks


#: Grams whose places are kept between calls.
KNOWN = 200_000


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def __call__(self, queries: list[str], passages: list[str]) -> np.ndarray: ...


class _Places(dict):
    """Of each gram the number that it counts in, those that count against it after the others; worked out once each."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, gram: str) -> int:
        h = zlib.crc32(gram.encode())
        self[gram] = at = h % self.dim + (0 if h >> 31 else self.dim)
        return at


class HashedEmbedder:
    """Signed counts of hashed character trigrams and words, of unit length."""

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim
        self.places = _Places(dim)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        if len(self.places) > KNOWN:
            self.places.clear()
        for i, t in enumerate(texts):
            t = t.lower()
            found = np.fromiter(map(self.places.__getitem__, [t[j : j + 3] for j in range(max(0, len(t) - 2))] + t.split()), np.int64)
            n = np.bincount(found, minlength=2 * self.dim)
            out[i] = n[: self.dim] - n[self.dim :]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class LexicalReranker:
    """A logistic of the share of the query's words that the passage has."""

    def __call__(self, queries: list[str], passages: list[str]) -> np.ndarray:
        share = [len(a & set(p.lower().split())) / max(1, len(a)) for a, p in ((set(q.lower().split()), p) for q, p in zip(queries, passages, strict=True))]
        return 1 / (1 + np.exp(-10 * (np.array(share, dtype=float) - 0.5)))


def embed(text: Column, make: Callable[[], Embedder] = HashedEmbedder, prefix: str = "passage") -> Column:
    """array<float>; the model is made once a task. prefix: passage or query, as such models want it."""

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(model([f"{prefix}: {t or ''}" for t in texts])))

    return run(text)


def rerank(query: Column, passage: Column, make: Callable[[], Reranker] = LexicalReranker) -> Column:
    """Probability that the passage is about the same as the query."""

    @pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, p in batches:
            yield pd.Series(model(list(q.fillna("")), list(p.fillna(""))))

    return run(query, passage)


def top_k(scored: DataFrame, by: str | list[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank; Spark cuts each task's rows to k before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def knn(queries: DataFrame, query_key: str, query_vector: str, base: DataFrame, key: str, vector: str, k: int, pairs: str = "all", places: int | None = None) -> DataFrame:
    """(query_key, key, cosine, rank): exact nearest neighbours of unit vectors by cosine, rounded to ``places`` if given; ties by key.

    Packs of queries meet blocks of the base in matrix products; each task reads
    its part of the base once and hands on k rows a query. ``pairs`` says which
    count: all, those of an "other" key, or those of a lower ("older") one.
    """
    near = blocks.nearest(blocks.met(queries, query_key, query_vector, base, key, vector), query_key, key, k, pairs, places)
    return top_k(near, query_key, k, F.desc("cosine") if places is None else F.round("cosine", places).desc(), F.col(key)).select(query_key, key, "cosine", "rank")


def fused(ranked: DataFrame, query_key: str, key: str, ranks: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rank columns."""
    return ranked.select(query_key, key, sum(1.0 / (k + F.col(r)) for r in ranks).alias("rrf"))

