"""The offline pipeline: pages to sections, chunks, entries, vectors and edges, each step one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.models import HashEmbedder
from ..operators import chunking, entries, graph
from ..sources import html


def embedded(rows: DataFrame, text: str, embedder=None, name: str = "embedding") -> DataFrame:
    return rows.withColumn(name, (embedder or HashEmbedder()).column(F.col(text)))


def build(pages: DataFrame, embedder=None, root: str = "#main-text", headings: list[str] = html.HEADINGS, threshold: float = K.SEMANTIC_THRESHOLD) -> dict[str, DataFrame]:
    """pages(url, html) -> sections, chunks, entries, explicit_edges, semantic_edges, leads. Entries without chunks have no vector and no edges."""
    parsed = html.parse_pages(pages.select("url", "html"), root, headings=headings)
    sections = html.page_sections(parsed)
    chunks = embedded(chunking.chunk_sections(sections, ["entry_slug", "section_ord"]), "chunk_text", embedder)
    docs = entries.entry_documents(sections)
    vectors = entries.mean_vectors(chunks, "entry_slug").withColumnRenamed("embedding", "graph_embedding")
    docs = embedded(docs, "search_text", embedder).join(vectors, "entry_slug", "left")
    known = docs.filter("graph_embedding is not null").select("entry_slug", "graph_embedding")
    valid = known.select(F.col("entry_slug").alias("slug"))
    links = html.link_counts(parsed)
    links = graph.induced(links, valid)
    semantic = graph.semantic_edges(known.withColumnRenamed("graph_embedding", "embedding"), "entry_slug", threshold)
    return {"sections": sections, "chunks": chunks, "entries": docs, "explicit_edges": links, "semantic_edges": semantic, "leads": html.page_leads(parsed)}
