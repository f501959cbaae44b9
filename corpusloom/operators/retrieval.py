"""Retrieval: exact top-k, expansion by entry, merging, fusion, confidence gate and pages.

Candidate frames have chunk_id (or entry_slug), cosine and what a score needs. Every order is total: ties go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.vectors import cosine, literal


def scored(rows: DataFrame, vector: list[float], embedding: str = "embedding") -> DataFrame:
    """rows with their cosine with a vector, and without their own."""
    return rows.withColumn("cosine", cosine(F.col(embedding), literal(vector))).drop(embedding)


def top_k(rows: DataFrame, vector: list[float], k: int, row_id: str, embedding: str = "embedding") -> DataFrame:
    """The k rows of greatest cosine with a vector, with it; rows without one come last."""
    return scored(rows, vector, embedding).orderBy(F.desc_nulls_last("cosine"), row_id).limit(k)


def top_per_group(rows: DataFrame, groups: DataFrame, group: str, n: int, row_id: str) -> DataFrame:
    """The n rows of greatest cosine of each of groups(group): a semi join, then a group limit."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last("cosine"), row_id))
    return rows.join(groups.select(group).distinct(), group, "left_semi").withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def merge_candidates(lists: list[DataFrame], row_id: str) -> DataFrame:
    """One row for each id: that of greatest cosine, of the earlier list on a tie."""
    rows = [df.withColumn("_list", F.lit(i)) for i, df in enumerate(lists)]
    union = rows[0]
    for df in rows[1:]:
        union = union.unionByName(df)
    best = F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc_nulls_last("cosine"), "_list"))
    return union.withColumn("_n", best).filter("_n = 1").drop("_n", "_list")


def entry_score(rerank: Column, cos: Column, title_bonus: Column) -> Column:
    return rerank + K.ENTRY_COSINE * cos + K.ENTRY_TITLE * title_bonus


def chunk_score(rerank: Column, cos: Column, parent: Column, title_bonus: Column, section_bonus: Column) -> Column:
    parent = F.greatest(F.coalesce(parent, F.lit(0.0)), F.lit(0.0))
    return rerank + K.CHUNK_COSINE * cos + K.CHUNK_PARENT * parent + K.CHUNK_TITLE * title_bonus + K.CHUNK_SECTION * section_bonus


def with_parent(chunks: DataFrame, entries: DataFrame, group: str = "entry_slug") -> DataFrame:
    """chunks with the score of their entry (null where it wasn't ranked). entries: the ranked candidates of one query, so a small side by its LIMIT."""
    return chunks.join(entries.select(group, F.col("final").alias("parent")), group, "left")


def confident(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """No rows at all if the first has both a low rerank score and a low cosine."""
    low = (F.col("rerank") < K.LOW_RERANK) & (F.col("cosine") < K.LOW_COSINE)
    flag = rows.filter((F.col(rank) == 1) & low).select(F.lit(1).alias("_one"), F.lit(True).alias("_low")).limit(1)
    return rows.withColumn("_one", F.lit(1)).join(flag, "_one", "left_anti").drop("_one")


def page(rows: DataFrame, offset: int, limit: int, rank: str = "rank") -> DataFrame:
    if offset < 0:
        raise ValueError("offset must not be negative")
    return rows.filter((F.col(rank) > offset) & (F.col(rank) <= offset + (limit or K.PAGE_SIZE)))


def budgets(window: int, candidate_limit: int | None = None) -> tuple[int, int]:
    """How many chunk and entry candidates a window of results needs."""
    chunks = max(candidate_limit or K.CHUNK_CANDIDATES, window * K.CHUNK_MULTIPLIER)
    return chunks, max(K.ENTRY_CANDIDATES, chunks, window * K.ENTRY_MULTIPLIER)


def widened(window: int, page_size: int) -> int:
    """The window rounded up to whole pages, and what is fetched ahead."""
    return -(-window // page_size) * page_size + K.PREFETCHED_PAGES * page_size


def group_by_entry(results: DataFrame, url: str = "url", rank: str = "rank") -> DataFrame:
    """Results by page, in the order in which the pages first appear: start (from 0) and how many passages."""
    return results.groupBy(F.split_part(F.col(url), F.lit("#"), F.lit(1)).alias("page_url")).agg((F.min(rank) - 1).alias("start"), F.count(F.lit(1)).alias("passages"))


def search_summary(results: DataFrame, url: str = "url") -> DataFrame:
    """(passages, entries): how many results there are, and on how many different pages."""
    return results.agg(F.count(F.lit(1)).alias("passages"), F.count_distinct(F.split_part(F.col(url), F.lit("#"), F.lit(1))).alias("entries"))
