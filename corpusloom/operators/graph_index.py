"""An approximate index of vectors: a navigable small-world graph with layers in each of many bounded partitions.

Rows are dealt into partitions of about `part_rows` rows by a hash of their id; one task builds the graph of one, and a
partition is one record of the stored index, so that a search reads it in place, without a shuffle. Equal vectors share a
node. A node stands in layer 0 and, with a chance that falls by LINKS, in each layer above. Its links in a layer are chosen
among its nearest nodes there: one that is nearer to the node than to any link chosen before it goes first, so that links
lead into all directions; links back are kept up to a bound, and what no path reaches is linked with the nearest node
that is reached. Paths lead from each node of a layer to every other. A search descends greedily and walks layer 0 with a bounded heap of candidates.

Rows whose vector is null, zero or not of the first dimension are in no graph.
"""

from __future__ import annotations

from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a partition, links of a node that it chooses, nodes that it chooses among, and candidates that a search holds at least.
PART_ROWS, LINKS, AMONG, HELD = 8192, 16, 64, 96

#: Bytes of queries, for all partitions, that are sent to all tasks; more meet the index by a shuffled join.
SENT = 64 << 20


def _chosen(x: np.ndarray, links: int, among: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, similarity) of the links that unit vectors choose, nearest and most diverse first."""
    n, among = len(x), min(among, len(x) - 1)
    out = []
    for at in range(0, n if among > 0 else 0, 256):
        s = x[at : at + 256] @ x.T
        rows = np.arange(len(s))
        s[rows, at + rows] = -np.inf
        near = np.argpartition(-s, among - 1, axis=1)[:, :among]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        to_node = np.take_along_axis(s, near, 1)
        to_each = x[near] @ x[near].transpose(0, 2, 1)
        kept = np.zeros(near.shape, bool)
        for c in range(among):
            blocked = (kept[:, :c] & (to_each[:, c, :c] >= to_node[:, c : c + 1])).any(1)
            kept[:, c] = ~blocked & (kept.sum(1) < links)
        order = np.argsort(~kept, axis=1, kind="stable")[:, :links]  # what is diverse, then the nearest of the rest
        out.append((np.repeat(at + rows, order.shape[1]), np.take_along_axis(near, order, 1).ravel(), np.take_along_axis(to_node, order, 1).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def _both_ways(n: int, links: int, src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> list[list[int]]:
    """Each node's links: its own choices, then the nearest of those that chose it, twice `links` at most."""
    a, b, s = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([sim, sim])
    own = np.repeat([0, 1], len(src))
    order = np.lexsort((-s, own, a))
    out: list[list[int]] = [[] for _ in range(n)]
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if len(out[i]) < 2 * links and j not in out[i]:
            out[i].append(j)
    return out


def _reach(x: np.ndarray, links: list[list[int]]) -> None:
    """Adds links until paths lead from each node to every other: a search may begin at any of them.

    A node has a link back to the one it is first reached from, so that paths lead to the first node as well as from it.
    """
    seen = np.zeros(len(x), bool)

    def walk(nodes: list[int]) -> None:
        seen[nodes] = True
        while nodes:
            reached = []
            for i in nodes:
                for j in links[i]:
                    if not seen[j]:
                        seen[j] = True
                        reached.append(j)
                        if i not in links[j]:
                            links[j].append(i)
            nodes = reached

    walk([0])
    for i in np.flatnonzero(~seen).tolist():
        if not seen[i]:
            near = int(np.argmax(np.where(seen, x @ x[i], -np.inf)))
            links[near].append(i)
            if near not in links[i]:  # a second link would bring a node twice
                links[i].append(near)
            walk([i])


class Graph:
    """A partition's graph: unit vectors and, for each layer, the links of its nodes as offsets and targets."""

    def __init__(self, unit: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], top: np.ndarray):
        self.unit, self.layers, self.top = unit, layers, top

    @classmethod
    def built(cls, unit: np.ndarray, links: int = LINKS, among: int = AMONG, seed: int = 5) -> Graph:
        n = len(unit)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 8)
        level[0] = max(level[0], 1)
        layers = []
        for layer in range(int(level.max()) + 1):
            there = np.flatnonzero(level >= layer)
            made = _both_ways(len(there), links, *_chosen(unit[there], links, among))
            _reach(unit[there], made)
            sizes = np.zeros(n + 1, np.int64)
            sizes[there + 1] = [len(x) for x in made]
            layers.append((np.cumsum(sizes), there[np.array([j for x in made for j in x], np.int64)]))
        return cls(unit, layers, np.flatnonzero(level == level.max()))

    def _walk(self, q: np.ndarray, layer: int, start: list[tuple[float, int]], held: int) -> tuple[list[tuple[float, int]], int]:
        """The best nodes of a layer that best-first search with a heap of `held` finds, and how many it has compared."""
        offsets, targets = self.layers[layer]
        seen = np.zeros(len(self.unit), bool)
        seen[[i for _, i in start]] = True
        best = sorted(start)[-held:]
        todo, compared = [(-s, i) for s, i in best], 0
        todo.sort()
        while todo:
            s, i = heappop(todo)
            if len(best) >= held and -s < best[0][0]:
                break
            near = targets[offsets[i] : offsets[i + 1]]
            near = near[~seen[near]]
            seen[near] = True
            compared += len(near)
            for t, j in zip((self.unit[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < held:
                    heappush(best, (t, j))
                elif t > best[0][0]:
                    heapreplace(best, (t, j))
                else:
                    continue
                heappush(todo, (-t, j))
        return best, compared

    def nearest(self, q: np.ndarray, held: int) -> tuple[list[int], int]:
        """Nodes near a unit vector, and how many nodes have been compared with it."""
        found = list(zip((self.unit[self.top] @ q).tolist(), self.top.tolist(), strict=True))
        compared = len(found)
        for layer in range(len(self.layers) - 1, -1, -1):
            found, n = self._walk(q, layer, found, held if layer == 0 else min(8, held))
            compared += n
        return [i for _, i in found], compared


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def build_index(rows: DataFrame, row_id: str, embedding: str = "embedding", part_rows: int = PART_ROWS, links: int = LINKS, among: int = AMONG) -> DataFrame:
    """The index of rows as a table with one record for each partition; write it, and read it back for searches.

    part, ids and their nodes, vectors (one for each node), and the graph.
    """
    kind = rows.schema[row_id].dataType
    good = rows.select(F.col(row_id).alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.exists("v", lambda c: c != 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    dim, n = (sizes[0]["d"], sizes[0]["count"]) if sizes else (0, 0)
    parts = max(1, -(-n // part_rows))

    def built(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        x, node = np.unique(table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim), axis=0, return_inverse=True)
        graph = Graph.built((x / _norms(x)[:, None]).astype(np.float32), links, among)
        one = lambda v, t: pa.array([v], t)
        return pa.table(
            {
                "part": table.column("part").slice(0, 1),
                "ids": pa.ListArray.from_arrays([0, table.num_rows], table.column("id").combine_chunks()),
                "nodes": one(node.astype(np.int32).tobytes(), pa.binary()),
                "vectors": one(x.tobytes(), pa.binary()),
                "offsets": one([o.tobytes() for o, _ in graph.layers], pa.list_(pa.binary())),
                "targets": one([t.tobytes() for _, t in graph.layers], pa.list_(pa.binary())),
                "top": one(graph.top.tobytes(), pa.binary()),
            }
        )

    schema = T.StructType().add("part", T.IntegerType()).add("ids", T.ArrayType(kind)).add("nodes", "binary").add("vectors", "binary").add("offsets", T.ArrayType(T.BinaryType())).add("targets", T.ArrayType(T.BinaryType())).add("top", "binary")
    dealt = good.filter(F.size("v") == dim).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInArrow(built, schema)


def search_index(index: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector", held: int = HELD, exclude_self: bool = False) -> DataFrame:
    """queries(query_id, vector) -> query_id, rank (from 1), id, cosine (exact) and compared: about the k rows of greatest cosine.

    Blocks of queries go to each partition of the index, each of which gives its own k; these are merged. compared: how many
    rows of all partitions a query has been compared with.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("q"))
    blocks = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(64)).alias("block")).agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
    last, size = index.agg(F.max("part")).first()[0], queries.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    if last is None:
        return index.sparkSession.createDataFrame([], T.StructType().add("query_id", asked.schema["query_id"].dataType).add("rank", "integer").add("id", index.schema["ids"].dataType.elementType).add("cosine", "double").add("compared", "long"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last))))
    small = size[0] * (size[1] or 0) * 8 * (last + 1) <= SENT
    pairs = index.join(F.broadcast(blocks) if small else blocks, "part")
    id_kind, query_kind = index.schema["ids"].dataType.elementType, asked.schema["query_id"].dataType
    held = max(held, 2 * k)

    def found(batches):
        for b in batches:
            for row in range(len(b)):
                of = {c: b.column(c)[row] for c in ("ids", "nodes", "vectors", "offsets", "targets", "top")}
                node, ids = np.frombuffer(of["nodes"].as_py(), np.int32), of["ids"].values
                x = np.frombuffer(of["vectors"].as_py(), np.float64).reshape(node.max() + 1, -1)
                norm = _norms(x)
                layers = [(np.frombuffer(o, np.int64), np.frombuffer(t, np.int64)) for o, t in zip(of["offsets"].as_py(), of["targets"].as_py(), strict=True)]
                graph = Graph((x / norm[:, None]).astype(np.float32), layers, np.frombuffer(of["top"].as_py(), np.int64))
                by_node = np.argsort(node, kind="stable")
                first = np.searchsorted(node[by_node], np.arange(len(x) + 1))
                out: dict[str, list] = {"query_id": [], "id": [], "cosine": [], "compared": []}
                for ask in b.column("asked")[row].as_py():
                    q = np.array(ask["q"] or [], float)
                    size = np.sqrt((q * q).sum())
                    if len(q) != x.shape[1] or not 0 < size < np.inf:
                        continue
                    near, compared = graph.nearest((q / size).astype(np.float32), held)
                    cos = np.clip(x[near] @ q / (norm[near] * size), -1, 1)
                    rows = [(-c, name) for c, i in zip(cos.tolist(), near, strict=True) for name in ids.take(pa.array(by_node[first[i] : first[i + 1]])).to_pylist() if not (exclude_self and name == ask["query_id"])]
                    for c, name in sorted(rows)[:k]:
                        for key, v in zip(out, (ask["query_id"], name, -c, compared), strict=True):
                            out[key].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=wanted)

    schema = T.StructType().add("query_id", query_kind).add("id", id_kind).add("cosine", "double").add("compared", "long")
    wanted = to_arrow_schema(schema)
    each = pairs.select("ids", "nodes", "vectors", "offsets", "targets", "top", "asked").mapInArrow(found, schema)
    over = Window.partitionBy("query_id")
    ranked = each.withColumn("rank", F.row_number().over(over.orderBy(F.desc("cosine"), "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "cosine", "compared")
