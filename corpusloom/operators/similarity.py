"""Exact cosine joins in blocks: all pairs over a threshold, each row's most similar rows, and the nearest rows of a batch of queries.

Rows gather around pivots (PIVOTS at most, far from one another, out of SAMPLE rows) and are dealt into blocks of one pivot,
those within NEAR of it apart from the others. A block has, for every pivot, the
least and the greatest angle of its rows to it. By the triangle inequality two rows are at least as far apart as their angles
to a pivot differ, so two blocks whose ranges lie too far apart at any pivot hold no pair over the threshold and never meet.
Each two blocks that are left meet once, and give both directions. Blocks are dealt into groups, and two groups are a cell, one
bounded task: so a block is shuffled once for each group, a fixed number of times, and not once for each block that it meets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import norm
from ..sources.store import written

#: Rows that pivots are chosen from, and the angle within which a row is near its pivot.
SAMPLE, NEAR = 4096, np.pi / 4

#: Pivots, rows of a block, and queries of a block. What rounding may take from an angle.
PIVOTS, BLOCK, QUERIES, ROUNDING = 256, 2048, 1024, 1e-6

#: Groups of blocks, at least, and the bytes of vectors in one; more rows than these hold make more groups.
GROUPS, GROUP_BYTES = 12, 1 << 26

#: Queries of a batch that the driver passes to tasks; a larger set is no batch of stated queries.
MOST_QUERIES = 65_536


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def far_apart(x: np.ndarray, k: int) -> np.ndarray:
    """At most k of these unit vectors, each the farthest from those before it."""
    chosen, closest = [0], x @ x[0]
    while len(chosen) < min(k, len(x)) and closest.min() < 1 - ROUNDING:
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, x @ x[chosen[-1]])
    return x[chosen]


def pivoted(rows: DataFrame, row_id: str, embedding: str = "embedding", block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, int, np.ndarray]:
    """(mine, ids, vs) of the rows with a direction: blocks as packed records, vs their unit vectors one after another, as a written table; the number of blocks, and the pivots."""
    x = F.col(embedding)
    good = rows.filter(norm(x) > 0).select(F.col(row_id).alias("id"), x.cast("array<double>").alias("v"))
    few = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    p = far_apart(_units(np.array([r["v"] for r in few])), min(pivots, -(-2 * good.count() // block))) if few else np.zeros((0, 0))

    def nearest(batches):
        for b in batches:
            if len(b):
                v = _units(b.column("v").flatten().to_numpy().reshape(len(b), -1))
                s = v @ p.T
                near = 2 * s.argmax(1) + (s.max(1) < np.cos(NEAR))
                lists = pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), lists, pa.array(near.astype(np.int32))], names=["id", "v", "near"])

    schema = T.StructType([*good.schema.fields, T.StructField("near", T.IntegerType())])
    near = written(good.mapInArrow(nearest, schema), "pivoted")
    first, plan = 0, []
    for r in near.groupBy("near").count().orderBy("near").collect():  # two rows a pivot
        n = -(-r["count"] // block)
        plan.append((r["near"], first, n))
        first += n
    table = rows.sparkSession.createDataFrame(plan, "near int, first int, n int")
    mine = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("n"))).cast("int")
    packed = near.join(F.broadcast(table), "near").groupBy(mine.alias("mine")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return written(packed.select("mine", F.col("r.id").alias("ids"), F.flatten("r.v").alias("vs")), "blocks"), first, p


def block_pairs(packed: DataFrame, blocks: int, pivots: np.ndarray, least: float) -> DataFrame:
    """(mine, other, gap), mine < other: the pairs of blocks that can hold a pair with a cosine of at least `least`, and the least angle of such a pair."""

    def ranged(batches):
        for b in batches:
            lo, hi = [], []
            for vs in b.column("vs"):
                angles = np.arccos(np.clip(vs.values.to_numpy().reshape(-1, pivots.shape[1]) @ pivots.T, -1, 1))
                lo.append(angles.min(0))
                hi.append(angles.max(0))
            yield pa.RecordBatch.from_arrays([b.column("mine"), pa.array(lo, pa.list_(pa.float64())), pa.array(hi, pa.list_(pa.float64()))], names=["mine", "lo", "hi"])

    ranges = written(packed.select("mine", "vs").mapInArrow(ranged, "mine int, lo array<double>, hi array<double>"), "block-ranges")
    left = ranges.select("mine", F.col("lo").alias("a"), F.col("hi").alias("b"), F.explode(F.sequence(F.col("mine"), F.lit(blocks - 1))).alias("other")).filter("mine < other")
    both = left.join(ranges.select(F.col("mine").alias("other"), "lo", "hi"), "other")
    gaps = F.zip_with(F.zip_with("lo", "b", lambda x, y: x - y), F.zip_with("a", "hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return both.withColumn("gap", F.greatest(F.array_max(gaps), F.lit(0.0))).filter(F.cos(F.greatest(F.col("gap") - ROUNDING, F.lit(0.0))) >= least).select("mine", "other", "gap")


def _best(s: np.ndarray, names: np.ndarray, threshold: float, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries of each row over the threshold; with k, of its k greatest, equal ones by name."""
    if k is not None and s.shape[1] > k:
        kth = np.maximum(-np.partition(-s, k - 1, axis=1)[:, k - 1], np.nextafter(threshold, 2))
        i, j = np.nonzero(s >= kth[:, None])
        order = np.lexsort((names[j], -s[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        return i[place < k], j[place < k]
    return np.nonzero(s > threshold)


class _Top:
    """The k best of each row of a cell so far: scores and places in the order of names. least: what a score must reach to come in."""

    def __init__(self, rows: int, threshold: float, k: int):
        self.scores, self.places = np.full((rows, k), -np.inf), np.zeros((rows, k), np.int64)
        self.least, self.k = np.full(rows, np.nextafter(threshold, 2)), k

    def add(self, first: int, s: np.ndarray, places: np.ndarray) -> None:
        """s: rows from `first` on against columns of these places."""
        least = self.least[first : first + len(s)]
        i, j = np.nonzero(s >= least[:, None])
        if len(i) > 64 * len(s) and s.shape[1] > self.k:
            i, j = np.nonzero(s >= np.maximum(-np.partition(-s, self.k - 1, axis=1)[:, self.k - 1], least)[:, None])
        rows = np.unique(i)
        at = np.concatenate([i, np.repeat(rows, self.k)])
        score = np.concatenate([s[i, j], self.scores[first + rows].ravel()])
        place = np.concatenate([places[j], self.places[first + rows].ravel()])
        order = np.lexsort((place, -score, at))
        at, score, place = at[order], score[order], place[order]
        n = np.arange(len(at)) - np.searchsorted(at, at)
        at, score, place, n = (x[n < self.k] for x in (at, score, place, n))
        self.scores[first + at, n], self.places[first + at, n] = score, place
        self.least[first + rows] = np.maximum(self.least[first + rows], self.scores[first + rows, -1])


def celled(pairs: DataFrame, packed: DataFrame, blocks: int, row_bytes: int) -> DataFrame:
    """(cell, mine, ids, vs, partners) of pairs(mine, other, gap): a cell is two groups of blocks, a partition of its own. A block is
    sent to each cell that has a pair of it, as often as there are groups at most, not once a pair; partners are the others of its pairs."""
    groups = min(blocks, max(GROUPS, -(-blocks * row_bytes // GROUP_BYTES)))
    i, j = (F.pmod(F.col(c), F.lit(groups)) for c in ("mine", "other"))
    high = F.greatest(i, j)
    told = pairs.withColumn("cell", (high * (high + 1) / 2 + F.least(i, j)).cast("int"))
    here = told.groupBy("cell", "mine").agg(F.collect_list(F.struct("other", "gap")).alias("partners"))
    there = told.select("cell", F.col("other").alias("mine"), F.filter(F.array(F.struct("other", "gap")), lambda _: F.lit(False)).alias("partners"))
    needed = here.unionByName(there.distinct()).groupBy("cell", "mine").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    return packed.join(written(needed, "cells"), "mine").repartitionById(groups * (groups + 1) // 2, F.col("cell"))


def similar_pairs(rows: DataFrame, threshold: float, row_id: str, k: int | None = None, block: int = BLOCK, embedding: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(src, dst, similarity) of all ordered pairs of different rows with a cosine over the threshold; with k, each row's k most similar only.

    With k, blocks first meet themselves; two blocks then need not meet where no pair of theirs can be over the k-th best of
    a row of either so far. Ids must be distinct; zero vectors are similar to nothing.
    """
    kind = rows.schema[row_id].dataType
    packed, blocks, p = pivoted(rows, row_id, embedding, block, pivots)
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("similarity", T.DoubleType())])
    if not blocks:
        return rows.sparkSession.createDataFrame([], schema)
    wanted, width = to_arrow_schema(schema), p.shape[1]

    def matched(x, y, i, j, s):
        return pa.RecordBatch.from_arrays([x.take(pa.array(i)), y.take(pa.array(j)), pa.array(s)], schema=wanted)

    def within(batches):
        for b in batches:
            for r in range(len(b)):
                ids, v = b.column("ids")[r].values, b.column("vs")[r].values.to_numpy().reshape(-1, width)
                s = np.clip(v @ v.T, -1, 1)
                np.fill_diagonal(s, -2)
                i, j = _best(s, np.array(ids.to_pylist()), threshold, k)
                yield matched(ids, ids, i, j, s[i, j])

    def between(batches):
        cells = {}
        for b in batches:
            for r in range(len(b)):
                cells.setdefault(b.column("cell")[r].as_py(), []).append([b.column(c)[r] for c in ("mine", "ids", "vs", "partners")])
        for cell in cells.values():
            ids, vs = [x.values for _, x, _, _ in cell], [x.values.to_numpy().reshape(-1, width) for _, _, x, _ in cell]
            at = {m.as_py(): n for n, (m, _, _, _) in enumerate(cell)}
            first = np.cumsum([0, *map(len, ids)])
            meet = sorted((x["gap"], n, at[x["other"]]) for n, (_, _, _, partners) in enumerate(cell) for x in partners.as_py())
            if k is not None:
                named = pa.concat_arrays(ids)
                ordered = named.take(named_order := pc.sort_indices(named))
                places = np.empty(len(named), np.int64)
                places[named_order.to_numpy()] = np.arange(len(named))
                top = _Top(len(named), threshold, k)
            for gap, m, n in meet:
                one, two = slice(first[m], first[m + 1]), slice(first[n], first[n + 1])
                if k is not None and np.cos(max(gap - ROUNDING, 0.0)) < min(top.least[one].min(), top.least[two].min()):
                    continue
                s = vs[m] @ vs[n].T
                np.clip(s, -1, 1, out=s)
                if k is None:
                    i, j = np.nonzero(s > threshold)
                    yield matched(ids[m], ids[n], i, j, s[i, j])
                    yield matched(ids[n], ids[m], j, i, s[i, j])
                else:
                    top.add(first[m], s, places[two])
                    top.add(first[n], s.T, places[one])
            if k is not None:
                i, n = np.nonzero(top.scores > -np.inf)
                yield matched(named, ordered, i, top.places[i, n], top.scores[i, n])

    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    inside = packed.repartition("mine").select("ids", "vs").mapInArrow(within, schema)
    pairs = block_pairs(packed, blocks, p, threshold)
    if k is not None:
        inside = written(inside, "inside-blocks")
        present = inside.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("s"))
        floor = packed.select("mine", F.explode("ids").alias("src")).join(present, "src", "left")
        floor = floor.groupBy("mine").agg(F.min(F.when(F.col("n") >= k, F.col("s")).otherwise(threshold)).alias("floor"))
        pairs = pairs.join(floor.withColumnRenamed("floor", "f1"), "mine").join(floor.select(F.col("mine").alias("other"), F.col("floor").alias("f2")), "other")
        pairs = pairs.filter(F.cos(F.greatest(F.col("gap") - ROUNDING, F.lit(0.0))) >= F.least("f1", "f2"))
    pairs = written(pairs.select("mine", "other", "gap"), "block-pairs")
    both = inside.unionByName(celled(pairs, packed, blocks, block * width * 8).mapInArrow(between, schema))
    return both if k is None else both.withColumn("_n", rank).filter(F.col("_n") <= k).drop("_n")


def batch_top_k(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, embedding: str = "embedding") -> DataFrame:
    """queries(query_id, vector) against all rows: (query_id, row_id, cosine, rank), each one's k rows of greatest cosine, ties by id.

    A stated batch, MOST_QUERIES at most, passed to the tasks in blocks; each batch of rows gives a query its own k best
    before anything is shuffled. Rows or queries without a direction come last, with a null cosine.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.col("vector").cast("array<double>").alias("v")).limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"a batch has at most {MOST_QUERIES} queries")
    kinds = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(row_id, rows.schema[row_id].dataType), T.StructField("cosine", T.DoubleType())])
    wanted = to_arrow_schema(kinds)
    named = pa.array([r["q"] for r in asked], wanted.field(0).type)

    def found(batches):
        for b in batches:
            ids = b.column("id")
            order_of = np.array(ids.to_pylist())
            for at in range(0, len(asked), QUERIES):
                part = asked[at : at + QUERIES]
                width = max([len(r["v"] or ()) for r in part], default=0)
                x = np.zeros((len(b), width))
                q = np.zeros((len(part), width))
                for m, vectors in ((x, b.column("v").to_pylist()), (q, [r["v"] for r in part])):
                    for i, v in enumerate(vectors):
                        if v is not None and len(v) == width and None not in v:
                            m[i] = v
                size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
                with np.errstate(all="ignore"):
                    s = np.where(size > 0, np.clip(q @ x.T / size, -1, 1), -2)  # -2: no direction
                s = np.where(np.isnan(s), -2, s)
                i, j = _best(s, order_of, -3, k)
                yield pa.RecordBatch.from_arrays([named.take(pa.array(i + at)), ids.take(pa.array(j)), pa.array(s[i, j], mask=s[i, j] < -1)], schema=wanted)

    near = rows.select(F.col(row_id).alias("id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(found, kinds)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc_nulls_last("cosine"), row_id))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)

