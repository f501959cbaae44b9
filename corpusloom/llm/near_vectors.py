"""Embedding near-dedup: a forest of random-projection trees with spill overlap.

Equal vectors count as one, with a weight. Each of TREES trees splits the unit vectors again and again by a random
direction at about the median; rows within SPILL of a cut go to both sides. The trees are fitted to at most SAMPLE rows
(those with the smallest hash of the id) until a leaf holds about LEAF of all rows, or a split would part nothing, as in a
crowd of near copies; every row is routed through every tree. Rows are compared within leaves by exact cosine, in blocks of
at most about BLOCK rows, so that a large leaf is many tasks of bounded size. A pair that shares several leaves is counted
in the first of them, for which each row carries its leaves; only sums and the least linked id of each block are written,
no pairs. Components join what was linked.

A pair at the threshold itself is parted by one tree in about six (50,000 rows, 64 dimensions), so by all 8 in one case of a
million; nearer pairs are parted more seldom. A crowd of n different vectors that no split can part costs n * n / 2 cosines,
as matrix products spread over groups of bounded size; nothing is passed over.

Cases: vectors that are null, zero, of another dimension than most rows have, or that hold null or non-finite components
link with nothing; rows without vec_id are left out; rows with one id count as one row (the smallest valid vector); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .ann import valid_vectors
from .common import give_back, table, written
from .components import components

#: Cosine from which on two vectors are linked.
THRESHOLD = 0.95

#: Trees, rows that they are fitted to, rows of a leaf and of a block, directions that a split may choose from.
TREES, SAMPLE, LEAF, BLOCK, CHOICES = 8, 20_000, 512, 512, 3

#: Half the width of the overlap at a cut, as a share of what a pair at the threshold differs by along a random direction.
SPILL = 0.5

#: A split is worth while if it leaves at most this share of the pairs. Splits from root to leaf.
USEFUL, DEPTH = 0.9, 32


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by powers of two first, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Forest:
    """For each tree and node: the direction of its level that it splits by (-1: a leaf), the cut, and its left child (the right one comes next)."""

    def __init__(self, sample: np.ndarray, rows: int, dim: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 5):
        self.directions = np.random.default_rng(seed).standard_normal((trees, DEPTH * CHOICES, dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.width = spill * np.sqrt(2 - 2 * THRESHOLD) / np.sqrt(dim)
        self.trees = [self._grown(sample @ d.T, leaf * len(sample) / max(rows, 1)) for d in self.directions]

    def _grown(self, along: np.ndarray, leaf: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pick, cut, child = [-1], [0.0], [0]
        level = [(0, np.arange(len(along)))]
        for depth in range(DEPTH):
            after = []
            for node, rows in level:
                if len(rows) <= leaf or len(rows) < 4:
                    continue
                best = None
                for c in range(depth * CHOICES, (depth + 1) * CHOICES):
                    p = along[rows, c]
                    for x in np.quantile(p, (0.5, 0.4, 0.6)).tolist():
                        left, right = p <= x + self.width, p >= x - self.width
                        cost = float(left.sum()) ** 2 + float(right.sum()) ** 2
                        if best is None or cost < best[0]:
                            best = cost, c, x, left, right
                if best[0] <= USEFUL * len(rows) ** 2:
                    pick[node], cut[node], child[node] = best[1], best[2], len(pick)
                    after += [(len(pick), rows[best[3]]), (len(pick) + 1, rows[best[4]])]
                    pick += [-1, -1]
                    cut += [0.0, 0.0]
                    child += [0, 0]
            level = after
        return np.array(pick), np.array(cut), np.array(child)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves of these unit vectors, by row and leaf; the leaves of all trees are numbered through."""
        rows, found, first = [], [], 0
        for (pick, cut, child), directions in zip(self.trees, self.directions, strict=True):
            row, node, depth = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            while len(row):
                done = pick[node] < 0
                rows.append(row[done])
                found.append(node[done] + first)
                row, node = row[~done], node[~done]
                p = (x @ directions[depth * CHOICES : (depth + 1) * CHOICES].T)[row, pick[node] - depth * CHOICES] if len(row) else np.zeros(0)
                left, right = p <= cut[node] + self.width, p >= cut[node] - self.width
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([child[node[left]], child[node[right]] + 1])
                depth += 1
            first += len(pick)
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((found, rows))
        return rows[order], found[order]


def _first_shared(i: np.ndarray, j: np.ndarray, leaves: pa.ListArray, leaf: int) -> np.ndarray:
    """Of each pair of rows, if they share no leaf before this one."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    kept = leaves.take(pa.array(used))
    owner, flat = np.repeat(np.arange(len(used)), np.diff(kept.offsets.to_numpy())), kept.flatten().to_numpy()
    owner, flat = owner[flat < leaf], flat[flat < leaf]
    names, code = np.unique(flat, return_inverse=True)
    has = np.zeros((len(used), len(names)), np.float32)
    has[owner, code] = 1
    return (has @ has.T)[at[: len(i)], at[len(i) :]] == 0


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each row is connected with."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def linked(rows: pa.Table, kind: str) -> pa.Table:
    """Rows of a leaf's block, or of two blocks, vectors as bytes of this kind -> (id, links, root) of the rows that have links counted here."""
    rows = rows.combine_chunks().sort_by("id")
    ids, weight, block, leaf = (rows.column(c).to_numpy() for c in ("id", "weight", "block", "leaf"))
    x = unit(np.frombuffer(b"".join(rows.column("vector").to_pylist()), kind).reshape(len(ids), -1).astype(float))
    alike = np.triu(x @ x.T >= THRESHOLD, 1)
    if block.min() != block.max():
        alike &= block[:, None] != block[None, :]
    i, j = np.nonzero(alike)
    if len(i):
        first = _first_shared(i, j, rows.column("leaves").combine_chunks(), int(leaf[0]))
        i, j = i[first], j[first]
    links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    root, there = _roots(len(ids), i, j), links > 0
    return pa.table({"id": ids[there], "links": links[there].astype(np.int64), "root": ids[root[there]]})


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each id: its direct links and the least id that links lead to."""
    every = rows.select(F.col(vec_id).cast("long").alias("vec_id")).filter("vec_id is not null").distinct()
    valid, dim = valid_vectors(rows, vec_id, vector)
    if not dim:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    valid = valid.select("vec_id", "vector", F.xxhash64(F.lit(0), "vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2"))
    classes = written(valid.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.min("vector").alias("vector")), "vector-classes")
    known = classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()  # bounded by `sample`
    forest = Forest(unit(np.array([r["vector"] for r in known])), classes.count(), dim, trees, leaf)
    kind = "<f4" if isinstance(rows.schema[vector].dataType.elementType, FloatType) else "<f8"

    def routed(batches):
        for b in batches:
            for at in range(0, len(b), 4096):
                part = b.slice(at, 4096)
                x = part.column("vector").flatten().to_numpy().reshape(len(part), dim)
                row, leaves = forest.leaves(unit(x))
                vectors = [v.tobytes() for v in x.astype(kind)]
                lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32), pa.array(leaves.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("weight"), pa.array(vectors, pa.binary()), lists], names=["id", "weight", "vector", "leaves"])
        give_back()

    placed = written(classes.select("id", "weight", "vector").mapInArrow(routed, "id long, weight long, vector binary, leaves array<int>"), "routed-vectors")
    sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    meet = placed.withColumn("leaf", F.explode("leaves")).join(F.broadcast(sizes), "leaf")  # as many rows as the forest has leaves, at most 2 * sample * trees
    meet = meet.withColumn("block", F.pmod(F.xxhash64("id", "leaf"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "weight", "block", "vector", "leaves")
    found = written(meet.groupBy("leaf", "low", "high").applyInArrow(lambda part: linked(part, kind), "id long, links long, root long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    of_class = classes.drop("vector").join(links, "id", "left").join(roots, "id", "left")
    of_class = of_class.select("k1", "k2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    good = valid.drop("vector").join(of_class, ["k1", "k2"]).drop("k1", "k2")
    out = every.join(good, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
