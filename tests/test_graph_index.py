"""The graph index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph_index, retrieval
from corpusloom.plans.service import SearchService

SCHEMA = "chunk_id string, embedding array<float>"


def recall(found, rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["cosine"], r["compared"]))
    hits = read = 0
    for q, v in queries:
        cos = u @ (np.array(v) / np.linalg.norm(v))
        best = set(ids[np.lexsort((ids, -cos.round(12)))[:k]].tolist())
        got = sorted(by[q])
        assert [r for r, *_ in got] == list(range(1, min(k, len(rows)) + 1))
        assert all(abs(c - cos[np.flatnonzero(ids == i)[0]]) < 1e-6 for _, i, c, _ in got)
        assert [(-c, i) for _, i, c, _ in got] == sorted((-c, i) for _, i, c, _ in got)
        hits += len(best & {i for _, i, _, _ in got})
        read += got[0][3]
    return hits / (k * len(queries)), read / (len(queries) * len(rows))


def clustered(rng, n, d, groups, spread):
    x = rng.standard_normal((groups, d))[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, d))
    return [(f"c{i:05d}", v.tolist()) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("groups, spread, share", [(40, 0.3, 0.3), (1, 100.0, 0.5)])
def test_recall(spark, groups, spread, share):
    rng = np.random.default_rng(8)
    rows = clustered(rng, 4000, 32, groups, spread)
    queries = [(i, (np.array(rows[i * 37][1]) + 0.1 * spread * rng.standard_normal(32)).tolist()) for i in range(40)]
    index = graph_index.build_index(spark.createDataFrame(rows, SCHEMA), "chunk_id", part_rows=2000).persist()
    asked = spark.createDataFrame(queries, "query_id int, vector array<double>")
    found = graph_index.search_index(index, asked, 10).collect()
    got, read = recall(found, rows, queries, 10)
    assert index.count() == 2 and got >= 0.9 and read < share
    plan = graph_index.search_index(index, asked, 10)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [2.0, 0.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [float("nan"), 1.0]), ("g", [1.0]), (None, [1.0, 1.0]), ("h", [0.0, 1.0])]
    index = graph_index.build_index(spark.createDataFrame(rows, SCHEMA), "chunk_id")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("y", None), ("x", [1.0])], "query_id string, vector array<double>")
    assert [(r["query_id"], r["rank"], r["id"], r["cosine"]) for r in graph_index.search_index(index, asked, 3).orderBy("rank").collect()] == [("a", 1, "a", 1.0), ("a", 2, "b", 1.0), ("a", 3, "c", 1.0)]
    assert [r["id"] for r in graph_index.search_index(index, asked, 9, exclude_self=True).orderBy("rank").collect()] == ["b", "c", "h"]
    none = graph_index.build_index(spark.createDataFrame([], SCHEMA), "chunk_id")
    assert graph_index.search_index(none, asked, 3).count() == 0
    with pytest.raises(ValueError):
        graph_index.search_index(index, asked, 0)


def test_clusters_are_linked():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((1, 16)) + 1e-4 * rng.standard_normal((n, 16)) for n in (3, 400, 1, 90, 2)])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = graph_index.Graph.built(x, links=4, among=16)
    for i in range(0, len(x), 7):
        found, _ = graph.nearest(x[i], len(x))
        assert len(found) == len(x)
    for layer, (offsets, _) in enumerate(graph.layers):
        there = np.flatnonzero(np.diff(offsets))
        for start in there:  # wherever a search begins, it comes to all nodes of the layer
            found, _ = graph._walk(x[start], layer, [(1.0, int(start))], len(x))
            assert sorted(i for _, i in found) == list(there)


def test_search_uses_the_index_on_request(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{i}", f"e{i % 9}", f"title {i % 9}", "part", f"u{i % 9}#x", f"text {i}", v) for i, (_, v) in enumerate(clustered(rng, 600, 24, 12, 0.4))]
    chunks = spark.createDataFrame(rows, "chunk_id string, entry_slug string, entry_title string, section_title string, url string, chunk_text string, embedding array<float>").persist()

    class Fixed:
        dimension = 24

        def query(self, spark, text):
            return rows[len(text)][6]

    exact, indexed = (SearchService(chunks, None, Fixed(), chunk_index=i) for i in (None, graph_index.build_index(chunks, "chunk_id").persist()))
    assert "embedding" not in indexed.retrieve_candidates(rows[3][6], 20).columns
    a, b = ({r["chunk_id"] for r in s.retrieve_candidates(rows[3][6], 20).collect()} for s in (exact, indexed))
    assert len(a & b) >= 18 and len(b) == 20
    assert retrieval.top_k(chunks, rows[3][6], 1, "chunk_id").first()["chunk_id"] == indexed.retrieve_candidates(rows[3][6], 20).orderBy(F.desc("cosine"), "chunk_id").first()["chunk_id"]
    assert indexed.search("abc", result_limit=3).count() == 3
