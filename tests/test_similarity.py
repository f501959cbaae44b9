"""Blocked cosine joins against all pairs."""

import numpy as np
import pytest

from corpusloom.operators import graph, similarity

SCHEMA = "id string, embedding array<float>"


def table(spark, rng, n, d, groups, spread):
    x = (rng.standard_normal((groups, d))[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, d))).astype(np.float32)
    rows = [(f"r{i:04d}", v.tolist()) for i, v in enumerate(x)]
    return rows, spark.createDataFrame([*rows, ("zero", [0.0] * d), ("none", None)], SCHEMA).repartition(3)


def all_pairs(rows, threshold, k=None):
    ids = [i for i, _ in rows]
    u = np.array([v for _, v in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    out = {}
    for i in range(len(ids)):
        best = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] > threshold)
        out |= {(ids[i], j): -x for x, j in best[:k]}
    return out


@pytest.mark.parametrize("threshold, k", [(0.85, None), (0.85, 3), (-1.0, 5), (0.999, None)])
def test_pairs(spark, threshold, k):
    rows, df = table(spark, np.random.default_rng(1), 700, 12, 25, 0.3)
    found = {(r["src"], r["dst"]): r["similarity"] for r in similarity.similar_pairs(df, threshold, "id", k, block=60).collect()}
    want = all_pairs(rows, threshold, k)
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-9 for p in want)


def test_blocks_that_cannot_reach_the_threshold_do_not_meet(spark):
    rows, df = table(spark, np.random.default_rng(2), 1200, 16, 20, 0.15)
    packed, blocks, pivots = similarity.pivoted(df, "id", block=40)
    formed = similarity.block_pairs(packed, blocks, pivots, 0.85).count()
    assert blocks >= 30 and formed < 0.2 * blocks * (blocks - 1) / 2
    want = all_pairs(rows, 0.85)
    assert {(r["src"], r["dst"]) for r in similarity.similar_pairs(df, 0.85, "id", block=40).collect()} == want.keys()
    best = all_pairs(rows, 0.85, 5)
    edges = {(r["src"], r["dst"]) for r in graph.semantic_edges(df, "id").collect()}
    assert edges == {(a, b) for a, b in best if a < b and (b, a) in best}


def test_a_block_is_sent_once_a_group(spark):
    rows, df = table(spark, np.random.default_rng(4), 800, 8, 20, 0.5)
    packed, blocks, pivots = similarity.pivoted(df, "id", block=16)
    pairs = similarity.block_pairs(packed, blocks, pivots, -1.0)
    cells = similarity.celled(pairs, packed, blocks, 16 * 8 * 8).cache()
    assert pairs.count() == blocks * (blocks - 1) // 2 > 2 * cells.count() and cells.count() <= blocks * similarity.GROUPS
    met = [(r["cell"], r["mine"], p["other"]) for r in cells.select("cell", "mine", "partners").collect() for p in r["partners"]]
    assert len(met) == len({m[1:] for m in met}) == pairs.count()
    there = {(r["cell"], r["mine"]) for r in cells.select("cell", "mine").collect()}
    assert all((c, other) in there for c, _, other in met)
    best = all_pairs(rows, -1.0, 4)
    assert {(r["src"], r["dst"]) for r in similarity.similar_pairs(df, -1.0, "id", 4, block=16).collect()} == best.keys()


def test_equal_similarities_go_by_name(spark):
    df = spark.createDataFrame([(f"r{i:03d}", [float(i % 2), float(1 - i % 2)]) for i in reversed(range(60))], SCHEMA)
    found = similarity.similar_pairs(df, 0.9, "id", 2, block=7)
    alike = {i: [f"r{j:03d}" for j in range(60) if j % 2 == i % 2 and j != i][:2] for i in range(60)}
    assert {(r["src"], r["dst"]) for r in found.collect()} == {(f"r{i:03d}", j) for i, js in alike.items() for j in js}


def test_batch(spark):
    rows, df = table(spark, np.random.default_rng(3), 300, 8, 10, 0.5)
    asked = [(i, rows[i * 7][1]) for i in range(20)] + [(50, [0.0] * 8)]
    found = similarity.batch_top_k(spark.createDataFrame(asked, "q int, vector array<double>"), df, 4, "q", "id").collect()
    u = np.array([v for _, v in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for q, v in asked[:-1]:
        s = u @ np.array(v) / np.linalg.norm(v)
        got = sorted((r["rank"], r["id"], r["cosine"]) for r in found if r["q"] == q)
        assert [i for _, i, _ in got] == [rows[j][0] for j in np.argsort(-s, kind="stable")[:4]] and np.allclose([c for *_, c in got], -np.sort(-s)[:4])
    assert [(r["rank"], r["id"], r["cosine"]) for r in found if r["q"] == 50] == [(1, "none", None), (2, "r0000", None), (3, "r0001", None), (4, "r0002", None)]
    assert similarity.batch_top_k(spark.createDataFrame([], "q int, vector array<double>"), df, 4, "q", "id").count() == 0


def test_nothing_is_similar_to_nothing(spark):
    assert similarity.similar_pairs(spark.createDataFrame([("z", [0.0, 0.0]), ("n", None)], SCHEMA), 0.5, "id").count() == 0
