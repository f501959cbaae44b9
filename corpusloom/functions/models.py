"""Models behind protocols. No neural model is at hand: the defaults are deterministic and say so by name.

An Embedder turns texts into vectors, a Reranker scores (query, text) pairs; both give a Column, so a pandas UDF over a
model fits as well as an expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lexical_tokens


#: Texts that the hashing embedder counts at once.
AT_ONCE = 512


class Embedder(Protocol):
    dimension: int

    def column(self, text: Column) -> Column: ...

    def query(self, spark, text: str) -> list[float]: ...


class Reranker(Protocol):
    def column(self, query: Column, text: Column) -> Column: ...


class HashEmbedder:
    """Signed feature hashing of the lexical tokens: expressions hash them, an Arrow function counts places and signs."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def column(self, text: Column) -> Column:
        n = self.dimension

        @F.pandas_udf("array<float>")
        def summed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                for i in range(0, len(batch), AT_ONCE):
                    places = batch.iloc[i : i + AT_ONCE]
                    count = np.array([0 if p is None else len(p) for p in places])
                    flat = np.concatenate([np.zeros(0, np.int64), *[p for p in places if p is not None and len(p)]]).astype(np.int64)
                    row = np.repeat(np.arange(len(places)), count)
                    total = np.bincount(row * n + flat // 2, 1.0 - 2.0 * (flat % 2), len(places) * n)
                    yield pd.Series(list(total.reshape(-1, n).astype(np.float32)))

        # of each token: twice its place, plus one where it counts as minus
        places = F.transform(lexical_tokens(text, True), lambda t: (F.pmod(F.xxhash64(t), F.lit(n)) * 2 + F.when(F.xxhash64(F.lit(1), t) % 2 == 0, 0).otherwise(1)).cast("int"))
        return summed(F.coalesce(places, F.array().cast("array<int>")))

    def query(self, spark, text: str) -> list[float]:
        return list(spark.range(1).select(self.column(F.lit(text)).alias("v")).first()["v"])


class LoadedEmbedder:
    """A real model: load() gives, once in each Python worker, a function from a list of texts to an array of vectors."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int, batch: int = 64):
        self.load, self.dimension, self.batch = load, dimension, batch

    def column(self, text: Column) -> Column:
        load, size = self.load, self.batch

        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                rows = [t or "" for t in texts]
                made = [v for i in range(0, len(rows), size) for v in np.asarray(model(rows[i : i + size]), np.float32)]
                yield pd.Series(made, dtype=object)

        return vectors(text)

    def query(self, spark, text: str) -> list[float]:
        return list(spark.range(1).select(self.column(F.lit(text)).alias("v")).first()["v"])


class LoadedReranker:
    """A real model: load() gives, once in each Python worker, a function from a list of (query, text) to scores."""

    def __init__(self, load: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]], batch: int = 64):
        self.load, self.batch = load, batch

    def column(self, query: Column, text: Column) -> Column:
        load, size = self.load, self.batch

        @F.pandas_udf("double")
        def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for queries, texts in batches:
                pairs = [(q or "", t or "") for q, t in zip(queries, texts, strict=True)]
                yield pd.Series([float(s) for i in range(0, len(pairs), size) for s in model(pairs[i : i + size])], dtype=float)

        return scores(query, text)


class LexicalReranker:
    """-4 for texts without a word of the query, up to 4 for texts with all of them."""

    def column(self, query: Column, text: Column) -> Column:
        q = F.array_distinct(lexical_tokens(query, True))
        shared = F.size(F.array_intersect(q, lexical_tokens(text, True)))
        return F.coalesce(F.try_divide(8.0 * shared, F.size(q)), F.lit(0.0)) - 4.0
