"""Approximate nearest neighbours: an inverted multi-index.

Both halves of the vectors are quantised apart, with CENTROIDS centroids each; a pair of centroids is a cell. A query
walks the pairs by the sum of its two distances with a heap, until the cells it has passed hold a share of all rows; their
entries are ranked by exact distance on the original vectors. The codebooks are fitted to SAMPLE rows (those with the
smallest hash of the id); every row is indexed. The cell counts (at most CENTROIDS ** 2 numbers) deal the entries out to
chunks of about CHUNK rows: small cells share one, a large one (many equal vectors) is split by a hash of the id.

The share is measured: PROBES rows are compared with all others, and the least share is taken at which the walks pass TARGET
of their true neighbours. It is small where vectors have clusters and large where they are random, at every size.

Queries travel to the chunks that they need. A chunk's queries are dealt into blocks of about QUERIES, and each chunk is
copied for its own blocks only; a chunk and a block are one bounded task.

Cases: vectors that are null, zero, of another dimension than most rows have, or that hold null or non-finite components
take no part, nor do null ids; rows with one id count as one row (the smallest vector); ties go to the smaller id; with
fewer candidates than k all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Centroids of a half, rows that the codebooks are fitted to, neighbours.
CENTROIDS, SAMPLE, K = 64, 20_000, 10

#: Rows that the share is measured with, and the part of their true neighbours that it is to pass.
PROBES, TARGET = 100, 0.97

#: Rows of a chunk of the index and queries of a block.
CHUNK, QUERIES = 4096, 1024


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that take part, one for each id, as (vec_id, vector), and their dimension."""
    good = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    x = F.col("vector")
    good = good.filter(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0))
    sizes = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0]["n"] if sizes else 0
    return good.filter(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector")), dim


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """At most k centroids of the rows of x."""
    x = x[np.random.default_rng(seed).permutation(len(x))]
    _, first = np.unique(x, axis=0, return_index=True)
    centroids = x[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def walk(near: tuple[np.ndarray, np.ndarray], counts: np.ndarray, need: int) -> list[int]:
    """Cells by the summed distance of their centroids, until they hold `need` rows. near: the query's distances to the centroids of each half."""
    orders = [np.argsort(d, kind="stable") for d in near]
    a, b = (d[o] for d, o in zip(near, orders, strict=True))
    width = len(b)
    heap, seen, cells, have = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
    while heap and have < need:
        _, i, j = heappop(heap)
        cell = int(orders[0][i] * width + orders[1][j])
        if counts[cell]:
            cells.append(cell)
            have += counts[cell]
        for nxt in ((i + 1, j), (i, j + 1)):
            if nxt not in seen and nxt[0] < len(a) and nxt[1] < width:
                seen.add(nxt)
                heappush(heap, (a[nxt[0]] + b[nxt[1]], *nxt))
    return cells


class Index:
    """entries: a table (vec_id, vector, cell, chunk); codebooks and the places of the cells are small arrays."""

    def __init__(self, vectors: DataFrame, dim: int, centroids: int = CENTROIDS, sample: int = SAMPLE):
        half = self.half = dim // 2
        rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # bounded by `sample`
        known = np.array([r["vector"] for r in rows])
        self.books = books = (kmeans(known[:, :half], centroids), kmeans(known[:, half:], centroids))
        width = len(books[1])

        def cells(batches):
            for pdf in batches:
                x = np.array(pdf["vector"].tolist()).reshape(len(pdf), -1)
                pdf["cell"] = nearest(x[:, :half], books[0]) * width + nearest(x[:, half:], books[1])
                yield pdf

        entries = written(vectors.mapInPandas(cells, "vec_id long, vector array<double>, cell int"), "ann-cells")
        counts = self.counts = np.zeros(len(books[0]) * width, np.int64)
        for r in entries.groupBy("cell").count().collect():  # at most CENTROIDS ** 2 rows
            counts[r["cell"]] = r["count"]
        self.size = int(counts.sum())
        self.places, chunk, room = [], -1, 0
        for cell in np.flatnonzero(counts).tolist():
            n = int(counts[cell])
            if n > CHUNK:
                split = -(-n // CHUNK)
                self.places.append((cell, chunk + 1, split))
                chunk, room = chunk + split, 0
            else:
                if n > room:
                    chunk, room = chunk + 1, CHUNK
                self.places.append((cell, chunk, 1))
                room -= n
        self.cells = entries
        places = vectors.sparkSession.createDataFrame(self.places, "cell int, first int, split int")
        self.entries = entries.join(F.broadcast(places), "cell").select("vec_id", "vector", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("split"))).cast("int").alias("chunk"))


def measured_share(index: Index, k: int = K, probes: int = PROBES, target: float = TARGET) -> float:
    """The least share of all rows that walks must look at to pass `target` of the k true neighbours of some rows, found by brute force."""
    books, half, counts = index.books, index.half, index.counts
    asked = [(r["vec_id"], np.array(r["vector"])) for r in index.cells.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(probes).select("vec_id", "vector").collect()]
    q = np.array([v for _, v in asked])

    def nearest_rows(batches):
        for pdf in batches:
            x, ids, cell = np.array(pdf["vector"].tolist()).reshape(len(pdf), -1), pdf["vec_id"].to_numpy(), pdf["cell"].to_numpy()
            out = []
            for n, (own, _) in enumerate(asked):
                d = ((x - q[n]) ** 2).sum(1)
                d[ids == own] = np.inf
                best = np.lexsort((ids, d))[:k]
                best = best[np.isfinite(d[best])]
                out.append(pd.DataFrame({"n": n, "vec_id": ids[best], "cell": cell[best], "d": d[best]}))
            yield pd.concat(out)

    rank = F.row_number().over(Window.partitionBy("n").orderBy("d", "vec_id"))
    true = index.cells.mapInPandas(nearest_rows, "n int, vec_id long, cell int, d double").withColumn("r", rank).filter(F.col("r") <= k).collect()  # k rows a probe
    cells_of: dict[int, list[int]] = {}
    for r in true:
        cells_of.setdefault(r["n"], []).append(r["cell"])
    at = []
    for n, cells in cells_of.items():
        near = tuple(((c - h) ** 2).sum(1) for h, c in zip((q[n][:half], q[n][half:]), books, strict=True))
        order = walk(near, counts, index.size)
        reached = dict(zip(order, np.cumsum(counts[order]) / index.size, strict=True))
        at += [reached[c] for c in cells]
    return float(np.quantile(at, target, method="higher")) if at else 1.0


def search(queries: DataFrame, index: Index, k: int = K, share: float | None = None) -> DataFrame:
    """queries(vec_id, vector) -> query_id, rank (from 1), vec_id, score: each query's k nearest other rows, by Euclidean distance. share: of all rows that a query looks at; measured by default."""
    books, half, counts = index.books, index.half, index.counts
    need = max(int(np.ceil((measured_share(index, k) if share is None else share) * index.size)), k + 1)
    chunks_of = {cell: range(first, first + split) for cell, first, split in index.places}

    def walked(batches):
        for pdf in batches:
            out = []
            for vec_id, vector in zip(pdf["vec_id"], pdf["vector"], strict=True):
                x = np.asarray(vector)
                near = tuple(((c - h) ** 2).sum(1) for h, c in zip((x[:half], x[half:]), books, strict=True))
                cells = walk(near, counts, need)
                seen = np.zeros(len(counts), bool)
                seen[cells] = True
                out.append((vec_id, vector, np.packbits(seen).tobytes(), sorted({c for cell in cells for c in chunks_of[cell]})))
            yield pd.DataFrame(out, columns=["query_id", "vector", "cells", "chunks"])

    def nearest_of(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(entries) or not len(asked):
            return none
        x, ids, cell = np.array(entries["vector"].tolist()), entries["vec_id"].to_numpy(), entries["cell"].to_numpy()
        found = []
        for q, vector, cells in zip(asked["query_id"], asked["vector"], asked["cells"], strict=True):
            seen = np.unpackbits(np.frombuffer(cells, np.uint8), count=len(counts)).astype(bool)
            at = np.flatnonzero(seen[cell] & (ids != q))
            d = np.sqrt(((x[at] - np.asarray(vector)) ** 2).sum(1))
            best = np.lexsort((ids[at], d))[:k]
            found.append(pd.DataFrame({"query_id": q, "vec_id": ids[at][best], "score": d[best]}))
        return pd.concat([none, *found])

    asked = written(queries.mapInPandas(walked, "query_id long, vector array<double>, cells binary, chunks array<int>"), "walks")
    asked = asked.withColumn("chunk", F.explode("chunks")).drop("chunks")
    blocks = asked.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    asked = asked.join(blocks, "chunk").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    entries = index.entries.join(blocks, "chunk").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = entries.groupBy("chunk", "block").cogroup(asked.groupBy("chunk", "block")).applyInPandas(nearest_of, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors, dim = valid_vectors(table(spark, sf_dir, "embeddings"))
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = written(vectors, "vectors")
    return search(vectors.filter("vec_id % 100 = 0"), Index(vectors, dim))
