"""A batch of queries, for a person to read."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import snippet
from .service import SearchService


def evaluate(service: SearchService, queries: list[str], results: int = K.EVAL_RESULTS, candidates: int = K.EVAL_CANDIDATES, chars: int = K.EVAL_SNIPPET) -> str:
    """A report with rank, entry, section and snippet of each query's first results."""
    if min(results, candidates, chars) <= 0:
        raise ValueError("results, candidates and chars must be positive")
    lines = []
    for query in queries:
        lines.append(f"Query: {query}")
        rows = service.search(query, candidates, results).withColumn("snippet", snippet(F.col("chunk_text"), chars)).collect()
        lines += [f"  {i}. {r['entry_title']} | {r['section_title']}\n     {r['snippet']}" for i, r in enumerate(rows, 1)] or ["  (no results)"]
    return "\n".join(lines)
