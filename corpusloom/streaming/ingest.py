"""Incremental ingest: a stream of new rows, each micro-batch upserted by key into a snapshot table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import Snapshots


def upsert_stream(new: DataFrame, root: str, keys: list[str], checkpoint: str, table: str = "rows", order: str | None = None) -> StreamingQuery:
    """Starts it; availableNow: takes what is there, then ends. Of rows with one key the last by the column `order` stays,
    whichever batch brings it; a batch that is replayed after a restart is known by the checkpoint and its id, and does nothing."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            Snapshots(batch.sparkSession, root).upsert(table, batch, keys, order, batch=(checkpoint, number))

    return new.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
