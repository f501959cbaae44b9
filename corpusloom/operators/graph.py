"""Graph operators over edges (src, dst, ...) and nodes (slug)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import fix_mojibake, maybe_mojibake
from ..sources.html import placed
from ..sources.store import written
from .similarity import similar_pairs


def _repaired_counts(counts: Column) -> Column:
    """The entries (key, value) of a map with their keys repaired. Of keys that become one, the highest value stays.

    Keys can only become one within their map, so that no grouping of all links is needed. Most maps have no key to repair.
    """
    pairs = F.sort_array(F.transform(F.map_entries(counts), lambda e: F.struct(fix_mojibake(e["key"]).alias("key"), e["value"].alias("value"))))
    last = F.transform(F.array(pairs), lambda a: F.filter(a, lambda e, i: ~e["key"].eqNullSafe(F.get(a, i + 1)["key"])))
    return F.when(maybe_mojibake(F.array_join(F.map_keys(counts), "")), F.get(last, F.lit(0))).otherwise(F.map_entries(counts))


def explicit_edges(sections: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sections(section_ord, entry_slug, outbound_links, outbound_link_counts) -> edges (src, dst, weight), and those whose target isn't in valid(slug).

    Only the first section of an entry counts; its link counts if it has them, else its links with weight 1.
    """
    src = sections.withColumn("src", fix_mojibake(F.col("entry_slug")))
    counts = F.coalesce("outbound_link_counts", F.map_from_arrays(F.array_distinct("outbound_links"), F.transform(F.array_distinct("outbound_links"), lambda _: F.lit(1))))
    first = src.groupBy("src").agg(_repaired_counts(F.min_by(F.struct(counts.alias("counts")), "section_ord")["counts"]).alias("links"))
    # Sources are checked while an entry is one row. Slugs aren't broadcast: made from numbers of a compressed table, they are far larger than Spark's size check takes them for.
    first = first.join(valid.select(F.col("slug").alias("src")).hint("merge"), "src", "left_semi")
    links = first.select("src", F.inline("links").alias("dst", "weight")).filter("src <> dst")
    targets = valid.select(F.col("slug").alias("dst")).hint("merge")
    return links.join(targets, "dst", "left_semi").select("src", "dst", "weight"), links.join(targets, "dst", "left_anti").select("src", "dst", "weight")


def mutual_neighbors(near: DataFrame, k: int) -> DataFrame:
    """near(src, dst, similarity), both ways -> pairs that are among each other's k nearest, once, src < dst."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    top = near.withColumn("_n", rank).filter(F.col("_n") <= k).select("src", "dst", "similarity")
    back = top.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return top.filter("src < dst").join(back, ["src", "dst"], "left_semi")


def semantic_edges(rows: DataFrame, row_id: str, threshold: float = K.SEMANTIC_THRESHOLD, k: int = K.SEMANTIC_NEIGHBORS) -> DataFrame:
    """(src, dst, similarity), src < dst: rows that are among each other's k most similar, over the threshold."""
    if not -1 <= threshold <= 1:
        raise ValueError("threshold must be within [-1, 1]")
    if k <= 0:
        raise ValueError("k must be positive")
    return mutual_neighbors(similar_pairs(rows, threshold, row_id, k), k)


def undirected(edges: DataFrame) -> DataFrame:
    """(slug, neighbor), distinct, both ways."""
    both = edges.select(F.col("src").alias("slug"), F.col("dst").alias("neighbor"))
    return both.union(both.select("neighbor", "slug")).distinct()


def well_linked(edges: DataFrame, least: int = K.MIN_EXPLICIT_DEGREE) -> DataFrame:
    """Nodes with at least so many different neighbours, in either direction."""
    return undirected(edges).groupBy("slug").agg(F.count("neighbor").alias("n")).filter(F.col("n") >= least).select("slug")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in nodes(slug)."""
    ends = nodes.select("slug").distinct()
    return edges.join(ends.withColumnRenamed("slug", "src"), "src", "left_semi").join(ends.withColumnRenamed("slug", "dst"), "dst", "left_semi")


def degrees(nodes: DataFrame, *edges: DataFrame) -> DataFrame:
    """nodes(slug) with their number of different neighbours over all kinds of edges; 0 for those without."""
    pairs = undirected(edges[0].select("src", "dst"))
    for e in edges[1:]:
        pairs = pairs.union(undirected(e.select("src", "dst")))
    n = pairs.distinct().groupBy("slug").agg(F.count("neighbor").alias("degree"))
    return nodes.join(n, "slug", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def neighborhood(center: str, hops: int, *edges: DataFrame) -> DataFrame:
    """The nodes (slug) within so many hops of one node, it included."""
    if hops not in (1, 2):
        raise ValueError("hops must be 1 or 2")
    pairs = undirected(edges[0].select("src", "dst"))
    for e in edges[1:]:
        pairs = pairs.union(undirected(e.select("src", "dst")))
    first = pairs.filter(F.col("slug") == center).select(F.col("neighbor").alias("slug"))
    seen = first.union(pairs.sparkSession.range(1).select(F.lit(center).alias("slug"))).distinct()
    if hops == 2:
        seen = seen.union(pairs.join(seen, "slug", "left_semi").select("neighbor")).distinct()
    return seen


def neighbor_sets(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy("slug").agg(F.array_sort(F.collect_set("neighbor")).alias("neighbors"))


def edge_budget(nodes: int, focused: bool) -> tuple[int, int]:
    """How many semantic edges are drawn, and how many at one node."""
    return (min(12_000, max(7_000, nodes * 6)), 12) if focused else (min(18_000, max(10_000, nodes * 12)), 18)


def scored_edges(semantic: DataFrame, explicit: DataFrame, focus: str | None) -> DataFrame:
    """semantic with score: similarity, and more for edges at the focus (2) or at one of its explicit neighbours (0.6)."""
    base = F.coalesce("similarity", F.lit(0.0))
    if focus is None:
        return semantic.withColumn("score", base)
    near = undirected(explicit).filter(F.col("slug") == focus).select("neighbor")
    marked = semantic.join(near.select(F.col("neighbor").alias("src"), F.lit(True).alias("_a")), "src", "left").join(near.select(F.col("neighbor").alias("dst"), F.lit(True).alias("_b")), "dst", "left")
    at_focus = (F.col("src") == focus) | (F.col("dst") == focus)
    extra = F.when(at_focus, 2.0).when(F.col("_a") | F.col("_b"), 0.6).otherwise(0.0)
    return marked.withColumn("score", base + extra).select(*semantic.columns, "score")


def thinned_edges(scored: DataFrame, budget: int, cap: int, focus: str | None = None) -> DataFrame:
    """The edges to draw: best first, while both ends have room (the focus has twice as much), until the budget is used.

    Greedy by a total order, so it runs by rounds of joins: an edge that is the best left at both its ends is taken.
    Ends that are full drop their other edges. Each round settles every locally best edge at once; the result is that of
    the sequential rule, apart from the budget, which cuts the taken edges in the same order.
    """
    if scored.count() <= budget:
        return scored
    order = F.struct(F.col("score").alias("s"), F.col("similarity").alias("m"), F.struct(F.col("src").alias("a"), F.col("dst").alias("b")).alias("e"))
    room = lambda end: F.when(F.lit(focus).isNotNull() & (F.col(end) == F.lit(focus)), 2 * cap).otherwise(cap)
    rows, rounds = scored.withColumns({"_o": order, "_src_room": room("src"), "_dst_room": room("dst")}), []
    best = lambda end: F.row_number().over(Window.partitionBy(end).orderBy(F.desc("_o")))
    while True:
        # Each end of an edge is many rows of one node: places are given by the node, over both of its sides.
        sides = rows.select(F.explode(F.array(F.struct("src", F.col("_src_room").alias("room")), F.struct(F.col("dst").alias("src"), F.col("_dst_room").alias("room")))).alias("n"), "_o")
        sides = sides.select(F.col("n.src").alias("slug"), F.col("n.room").alias("room"), "_o").withColumn("good", best("slug") <= F.col("room"))
        good = sides.groupBy("_o").agg(F.min("good").alias("_take"))
        told = sides.join(good, "_o")
        used = told.groupBy("slug").agg(F.sum(F.col("_take").cast("int")).alias("used"))  # so many places of each node go in this round
        new = rows.join(good, "_o")
        for end in ("src", "dst"):
            new = new.join(used.select(F.col("slug").alias(end), F.col("used").alias("_used")), end, "left").withColumn(f"_{end}_room", F.col(f"_{end}_room") - F.coalesce("_used", F.lit(0))).drop("_used")
        new = written(new, "thinning")
        rounds.append(new.filter("_take").select(*scored.columns, "_o"))
        rows = new.filter("not _take and _src_room > 0 and _dst_room > 0").drop("_take")
        if rows.isEmpty():
            break
    taken = rounds[0]
    for r in rounds[1:]:
        taken = taken.unionByName(r)
    return taken.orderBy(F.desc("_o")).limit(budget).select(*scored.columns)


def reconcile(documents: DataFrame, vectors: DataFrame, key: str = "slug") -> tuple[DataFrame, DataFrame]:
    """The keys that both sides have, and those of one side only with the side that lacks them; none in common is an error."""
    left, right = documents.select(key).distinct(), vectors.select(key).distinct()
    both = left.join(right, key, "left_semi")
    if both.isEmpty():
        raise ValueError("no key is on both sides")
    odd = left.join(right, key, "left_anti").withColumn("missing_in", F.lit("vectors")).union(right.join(left, key, "left_anti").withColumn("missing_in", F.lit("documents")))
    return both, odd


def summary(nodes: DataFrame, explicit: DataFrame, semantic: DataFrame, focused: bool = False) -> DataFrame:
    """(what, n): nodes, edges of both kinds, and whether semantic edges have to be thinned for drawing (1 or 0)."""
    kinds = [("nodes", nodes), ("explicit_edges", explicit), ("semantic_edges", semantic)]
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n") for what, df in kinds]
    counts = rows[0].union(rows[1]).union(rows[2])
    low, most, each = (7_000, 12_000, 6) if focused else (10_000, 18_000, 12)
    held = counts.groupBy().pivot("what", [k for k, _ in kinds]).agg(F.first("n"))
    budget = F.least(F.lit(most), F.greatest(F.lit(low), F.col("nodes") * each))
    return counts.union(held.select(F.lit("condensed"), (F.col("semantic_edges") > budget).cast("long")))


def drawing_order(nodes: DataFrame) -> DataFrame:
    """nodes(slug, degree) with their place in drawing, from 1: those with fewer neighbours first, so that the others lie on top."""
    return placed(nodes, "degree", "slug")


def node_radius(nodes: DataFrame) -> DataFrame:
    """nodes(slug, degree) with radius: a square-root scale from 4.5 to 13 over [0, greatest degree]."""
    top = nodes.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    return nodes.join(F.broadcast(top)).withColumn("radius", 4.5 + 8.5 * F.sqrt(F.col("degree") / F.col("top"))).drop("top")


def edge_width(edges: DataFrame) -> DataFrame:
    """edges(weight) with width: a linear scale from 0.8 to 3.2 over [1, greatest weight]."""
    top = edges.agg(F.greatest(F.max("weight"), F.lit(1)).alias("top"))
    return edges.join(F.broadcast(top)).withColumn("width", 0.8 + F.coalesce(F.try_divide(2.4 * (F.col("weight") - 1), F.col("top") - 1), F.lit(0.0))).drop("top")


def edge_opacity(edges: DataFrame) -> DataFrame:
    """edges(similarity) with opacity: a linear scale from 0.05 to 0.2 over [least or 0.5, greatest or 0.9]."""
    ends = edges.agg(F.least(F.min("similarity"), F.lit(0.5)).alias("lo"), F.greatest(F.max("similarity"), F.lit(0.9)).alias("hi"))
    return edges.join(F.broadcast(ends)).withColumn("opacity", F.coalesce(0.05 + 0.15 * F.try_divide(F.col("similarity") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.18))).drop("lo", "hi")

