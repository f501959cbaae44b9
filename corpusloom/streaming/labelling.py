"""Incremental labelling: a stateful stream that looks each entry up once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.classify import page_label, topic_label

#: What state is kept for an entry, and for how long (a day): the outcome of its labelling.
_OUTCOME, DAY_MS = "page string, payload string, error string", 86_400_000
_ROWS = "entry_slug string, page string, payload string, error string"


class _Once(StatefulProcessor):
    """The first row of each key, with what the lookup gives; nothing for a key whose outcome is remembered."""

    def __init__(self, lookup: Callable[[str], str | None], ttl_ms: int):
        self.lookup, self.ttl_ms = lookup, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.outcome = handle.getValueState("outcome", _OUTCOME, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of several rows in a batch the first by page label: one that has a label goes before those without.
        labels = sorted(x for pdf in rows for x in pdf["page"].tolist() if x is not None)
        if self.outcome.exists():
            return
        page, payload, error = (labels[0] if labels else None), None, None
        if page is None:
            try:
                payload = self.lookup(key[0])
            except Exception as e:  # a failure is an outcome: it is remembered and not tried again before it expires
                error = f"{type(e).__name__}: {e}"
        self.outcome.update((page, payload, error))
        yield pd.DataFrame({"entry_slug": [key[0]], "page": [page], "payload": [payload], "error": [error]}, dtype=object)

    def close(self) -> None:
        pass


def labelled(pages: DataFrame, lookup: Callable[[str], str | None], ttl_ms: int = DAY_MS) -> DataFrame:
    """A stream of (entry_slug, metas, text) -> (entry_slug, label, source, error), one row for an entry whose outcome isn't remembered.

    The page's own label goes first; only without one lookup(slug) is asked for a topic payload, once: the outcome, failures
    included, is kept in the stream's state for ttl_ms. source: page, topic, none or error. Rows without a slug are ignored.
    """
    conf = pages.sparkSession.conf  # such state needs this store
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = pages.filter("entry_slug is not null").select("entry_slug", page_label(F.col("metas"), F.col("text")).alias("page"))
    once = rows.groupBy("entry_slug").transformWithStateInPandas(_Once(lookup, ttl_ms), outputStructType=_ROWS, outputMode="Append", timeMode="ProcessingTime")
    topic = topic_label(F.col("payload"))
    source = F.when(F.col("page").isNotNull(), "page").when(F.col("error").isNotNull(), "error").when(topic.isNotNull(), "topic").otherwise("none")
    return once.select("entry_slug", F.coalesce("page", topic).alias("label"), source.alias("source"), "error")


def label_stream(pages: DataFrame, lookup: Callable[[str], str | None], path: str, checkpoint: str, ttl_ms: int = DAY_MS) -> StreamingQuery:
    """Starts the stream and appends its rows to the Parquet table at path; availableNow: takes what is there, then ends."""
    # State that expires by the clock asks for one empty batch after another: the stream would never end.
    pages.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return labelled(pages, lookup, ttl_ms).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
