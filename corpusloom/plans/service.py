"""The search and the graph service over stored tables."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.models import HashEmbedder, LexicalReranker
from ..functions.text import clean_text, rerank_text_of_chunk, rerank_text_of_entry, section_bonus, title_bonus
from ..operators import graph, graph_index, retrieval
from .results import ResultStore, result_key

LOG = logging.getLogger("corpusloom.search")


@dataclass
class _Window:
    rows: DataFrame
    made: float
    wanted: int
    n: int

    def serves(self, wanted: int) -> bool:
        return self.n < self.wanted or self.n >= wanted  # all there is, or enough


class SearchService:
    """Hybrid two-level retrieval over chunks(chunk_id, entry_slug, entry_title, section_title, url, chunk_text, embedding) and entries(entry_id, entry_slug, entry_title, url, section_outline, intro_text, embedding).

    chunk_index and entry_index, if given, are tables of graph_index.build_index over them: global candidates then come from
    the graphs, about the best ones, instead of from all rows. The expansion of entries is exact in either case.
    results, if given, is a store that other sessions share. After a search, stages has the rows of its stages and timings the
    milliseconds; with metrics (the default) both go to the log as one line.
    """

    def __init__(self, chunks: DataFrame, entries: DataFrame | None, embedder=None, reranker=None, chunk_index: DataFrame | None = None, entry_index: DataFrame | None = None, results: ResultStore | None = None, metrics: bool = True):
        self.chunks, self.entries = chunks, entries
        self.chunk_index, self.entry_index = chunk_index, entry_index
        self.spark = chunks.sparkSession
        self.embedder, self.reranker = embedder or HashEmbedder(), reranker or LexicalReranker()
        self.cache: OrderedDict[tuple[str, int | None], _Window] = OrderedDict()
        self.results, self.metrics = results, metrics
        self.stages: dict[str, int] = {}
        self.timings: dict[str, float] = {}

    def embed_query(self, text: str) -> list[float]:
        vector = self.embedder.query(self.spark, text)
        if len(vector) != self.embedder.dimension:
            raise ValueError(f"the query vector has {len(vector)} places, not {self.embedder.dimension}")
        return vector

    def _from_index(self, rows: DataFrame, index: DataFrame, vector: list[float], k: int, row_id: str) -> DataFrame:
        asked = self.spark.createDataFrame([(0, [float(v) for v in vector])], "query_id int, vector array<double>")
        found = graph_index.search_index(index, asked, k).select(F.col("id").alias(row_id), "cosine")
        return rows.drop("embedding").join(F.broadcast(found), row_id)  # k rows

    def retrieve_candidates(self, vector: list[float], limit: int | None = None) -> DataFrame:
        if self.chunk_index is not None:
            return self._from_index(self.chunks, self.chunk_index, vector, limit or K.CHUNK_CANDIDATES, "chunk_id")
        return retrieval.top_k(self.chunks, vector, limit or K.CHUNK_CANDIDATES, "chunk_id")

    def retrieve_entry_candidates(self, vector: list[float], limit: int | None = None) -> DataFrame | None:
        """None where there is no table of entries."""
        if self.entries is not None and self.entry_index is not None:
            return self._from_index(self.entries, self.entry_index, vector, limit or K.ENTRY_CANDIDATES, "entry_slug")
        return None if self.entries is None else retrieval.top_k(self.entries, vector, limit or K.ENTRY_CANDIDATES, "entry_slug")

    def retrieve_chunks_for_entries(self, vector: list[float], entries: DataFrame, each: int = K.CHUNKS_PER_ENTRY) -> DataFrame:
        """entries: few, by their LIMIT."""
        scored = retrieval.scored(self.chunks.join(F.broadcast(entries.select("entry_slug")), "entry_slug", "left_semi"), vector)
        return retrieval.top_per_group(scored, entries, "entry_slug", each, "chunk_id").orderBy(F.desc_nulls_last("cosine"), "chunk_id").limit(K.EXPANDED_ENTRIES * each)

    def rerank_entries(self, query: str, candidates: DataFrame) -> DataFrame:
        q = F.lit(query)
        rows = candidates.withColumn("rerank", self.reranker.column(q, rerank_text_of_entry(F.col("entry_title"), F.col("section_outline"), F.col("intro_text"))))
        rows = rows.withColumn("final", retrieval.entry_score(F.col("rerank"), F.col("cosine"), title_bonus(q, F.col("entry_title"))))
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("final"), F.desc("cosine"), "entry_slug")))

    def rerank_candidates(self, query: str, candidates: DataFrame, entries: DataFrame | None) -> DataFrame:
        q = F.lit(query)
        rows = candidates.withColumn("rerank", self.reranker.column(q, rerank_text_of_chunk(F.col("entry_title"), F.col("section_title"), F.col("chunk_text"))))
        rows = rows.withColumn("parent", F.lit(None).cast("double")) if entries is None else retrieval.with_parent(rows, entries)
        score = retrieval.chunk_score(F.col("rerank"), F.col("cosine"), F.col("parent"), title_bonus(q, F.col("entry_title")), section_bonus(q, F.col("section_title")))
        return rows.withColumn("final", score).withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("final"), F.desc("cosine"), "chunk_id")))

    def window(self, query: str, wanted: int, candidate_limit: int | None = None) -> DataFrame:
        """The ranked results of a query, enough for `wanted` of them, behind the confidence gate, persisted.

        One plan: rows of its stages are counted as they pass, by observations, and logged with the times when all is done.
        """
        start, seen = time.time(), {}
        vector = self.embed_query(query)
        embedded = time.time()

        def staged(name: str, df: DataFrame) -> DataFrame:
            if not self.metrics:
                return df
            seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
            return df.observe(seen[name], F.count(F.lit(1)).alias("rows"))

        n_chunks, n_entries = retrieval.budgets(wanted, candidate_limit)
        lists, ranked = [staged("chunk_candidates", self.retrieve_candidates(vector, n_chunks))], None
        try:
            if (found := self.retrieve_entry_candidates(vector, n_entries)) is not None:
                ranked = staged("entries", self.rerank_entries(query, found)).persist()  # used twice
                lists.append(staged("expanded_chunks", self.retrieve_chunks_for_entries(vector, ranked.filter(F.col("rank") <= K.EXPANDED_ENTRIES))))
            merged = staged("merged", retrieval.merge_candidates(lists, "chunk_id"))
            reranked = self.rerank_candidates(query, merged, ranked).persist()  # the gate looks at it first
            rows = retrieval.confident(reranked).persist()
            n = rows.count()
        finally:
            for df in (ranked, locals().get("reranked")):
                if df is not None:
                    df.unpersist()
        end = time.time()
        self.stages = {name: o.get["rows"] for name, o in seen.items()} | {"results": n}
        self.timings = {"embed_query_ms": (embedded - start) * 1000, "retrieve_ms": (end - embedded) * 1000}
        if self.metrics:
            LOG.info("%s", json.dumps({"event": "search", "query_chars": len(query), "wanted": wanted, "rows": self.stages, **{k: round(v, 1) for k, v in self.timings.items()}}))
        return rows

    def search(self, query: str, candidate_limit: int | None = None, result_limit: int | None = None, offset: int = 0) -> DataFrame:
        """One page of results: chunk_id, entry_title, section_title, url, chunk_text, cosine, rerank."""
        if len(query) > K.MAX_QUERY_CHARS:
            raise ValueError(f"a query has at most {K.MAX_QUERY_CHARS} characters")
        query = query.strip()
        if not query:
            raise ValueError("the query is empty")
        if offset < 0:
            raise ValueError("offset must not be negative")
        limit = result_limit or K.PAGE_SIZE
        if limit < 1:
            raise ValueError("result_limit must be positive")
        end = offset + limit
        key = query, candidate_limit
        held = self.cache.get(key)
        if held is None or time.time() - held.made > K.CACHE_SECONDS or not held.serves(end):
            shared = self.results.get(result_key(query, candidate_limit)) if self.results else None
            held = shared and _Window(*shared)
            if held is None or not held.serves(end):
                wanted = retrieval.widened(end, limit)
                rows = self.window(query, wanted, candidate_limit)
                held = _Window(rows, time.time(), wanted, rows.count())
                if self.results:
                    self.results.put(result_key(query, candidate_limit), rows, wanted, held.n)
            if key in self.cache:
                self.cache.pop(key).rows.unpersist()
            while len(self.cache) >= K.CACHED_QUERIES:
                self.cache.popitem(last=False)[1].rows.unpersist()
            self.cache[key] = held
        public = ["chunk_id", "entry_title", "section_title", "url", "chunk_text", "cosine", "rerank"]
        return retrieval.page(held.rows, offset, limit).orderBy("rank").select(*public)

    def pages(self, query: str, result_limit: int | None = None):
        """Page after page, until one isn't full."""
        limit, offset = result_limit or K.PAGE_SIZE, 0
        while True:
            rows = self.search(query, result_limit=limit, offset=offset).collect()
            if rows:
                yield rows
            if len(rows) < limit:
                return
            offset += limit


class GraphService:
    """Views of the concept graph over entries(entry_slug, entry_title, ...), explicit(src, dst, weight) and semantic(src, dst, similarity).

    leads(entry_slug, lead), if given, has what stands before an entry's first heading, for the centre of a neighbourhood.
    """

    def __init__(self, entries: DataFrame, explicit: DataFrame, semantic: DataFrame, leads: DataFrame | None = None):
        self.entries, self.explicit, self.semantic, self.leads = entries, explicit, semantic, leads
        self._full: dict[str, DataFrame] | None = None

    def _view(self, slugs: DataFrame) -> dict[str, DataFrame]:
        nodes = self.entries.withColumnRenamed("entry_slug", "slug").join(slugs, "slug", "left_semi")
        explicit, semantic = graph.induced(self.explicit, slugs), graph.induced(self.semantic, slugs)
        nodes = graph.degrees(nodes, explicit, semantic).orderBy(F.desc("degree"), "entry_title", "slug")
        return {"nodes": nodes, "explicit_edges": explicit.orderBy("src", "dst"), "semantic_edges": semantic.orderBy("src", "dst")}

    def get_full_graph(self) -> dict[str, DataFrame]:
        if self._full is None:
            self._full = {k: df.persist() for k, df in self._view(graph.well_linked(self.explicit)).items()}
        return self._full

    preload_full_graph_cache = get_full_graph

    def get_neighborhood(self, slug: str, hops: int = 1) -> dict[str, DataFrame]:
        slug = slug.strip()
        if not slug or hops not in (1, 2):
            raise ValueError("slug must not be empty, hops must be 1 or 2")
        if self.entries.filter(F.col("entry_slug") == slug).limit(1).count() == 0:
            raise LookupError(slug)
        view = self._view(graph.neighborhood(slug, hops, self.explicit, self.semantic))
        if self.leads is not None:
            lead = self.leads.filter(F.col("entry_slug") == slug).select(F.col("entry_slug").alias("slug"), clean_text(F.col("lead")).alias("lead"))
            view["nodes"] = view["nodes"].join(lead, "slug", "left").orderBy(F.desc("degree"), "entry_title", "slug")
        return view

    def health(self) -> dict[str, int]:
        """How many entries and edges there are."""
        return {name: df.count() for name, df in (("entries", self.entries), ("explicit_edges", self.explicit), ("semantic_edges", self.semantic))}


#: Columns that a front end reads, with their types, of each part of a view.
PAYLOAD = {
    "nodes": {"slug": "string", "entry_title": "string", "degree": "bigint"},
    "explicit_edges": {"src": "string", "dst": "string", "weight": "int"},
    "semantic_edges": {"src": "string", "dst": "string", "similarity": "double"},
}


#: Rows of a part of a view that payload takes to the driver, at most.
PAYLOAD_ROWS = 100_000


def check_payload(view: dict[str, DataFrame]) -> None:
    """A ValueError that names what a view lacks, or has with another type; further columns are allowed. No job runs."""
    wrong = [f"no {part}" for part in PAYLOAD if part not in view]
    for part in PAYLOAD.keys() & view.keys():
        have = dict(view[part].dtypes)
        wrong += [f"{part}.{c} is {have.get(c, 'missing')}, not {kind}" for c, kind in PAYLOAD[part].items() if have.get(c) != kind]
    if wrong:
        raise ValueError("; ".join(sorted(wrong)))


def _records(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def payload(view: dict[str, DataFrame], most: int = PAYLOAD_ROWS) -> str:
    """A view as one JSON object of lists of records: what a front end reads. A part of more than `most` rows is a ValueError,
    and comes to the driver no further than to tell; such views are written by write_payload."""
    check_payload(view)
    parts = []
    for name, df in view.items():
        rows = _records(df.limit(most + 1)).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        parts.append(f"{json.dumps(name)}:[{','.join(r[0] for r in rows)}]")
    return "{" + ",".join(parts) + "}"


def write_payload(view: dict[str, DataFrame], path: str) -> None:
    """A view of any size: a folder for each part, with its records as JSON lines in the order of the view. No row passes through the driver."""
    check_payload(view)
    for name, df in view.items():
        _records(df).write.mode("overwrite").text(f"{path}/{name}")


def create_search_service(spark: SparkSession, chunks_path: str, entries_path: str | None = None, embedder=None, reranker=None) -> SearchService:
    """Without a table at entries_path there are no entries: the search is one of chunks only."""
    try:
        entries = spark.read.parquet(entries_path) if entries_path else None
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        entries = None
    return SearchService(spark.read.parquet(chunks_path), entries, embedder, reranker)
