"""Search results that sessions share: one small table for each key, published by a rename, good for a time."""

from __future__ import annotations

import hashlib
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .. import constants as K


def result_key(query: str, limit: int | None) -> str:
    """The same key as functions.text.cache_key's, on the driver."""
    return hashlib.sha256(f"{limit!r}\0{query}".encode()).hexdigest()


class ResultStore:
    """root/<key>/<made, ms>-<wanted>-<rows>-<id>: a folder of Parquet files is written aside and takes this name when it is whole.

    get() takes the newest; one that is too old, cannot be read or has not the rows that its name tells is a miss and is dropped.
    """

    def __init__(self, spark: SparkSession, root: str, seconds: float = K.CACHE_SECONDS):
        self.spark, self.root, self.seconds = spark, root.rstrip("/"), seconds
        self._jvm = spark.sparkContext._jvm
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _entries(self, key: str) -> list[tuple[int, int, int, str]]:
        """(made, wanted, rows, name), the newest first."""
        if not self._files.exists(self._path(key)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(key))]
        return sorted(((*map(int, n.split("-")[:3]), n) for n in names if n.count("-") == 3), reverse=True)

    def get(self, key: str) -> tuple[DataFrame, float, int, int] | None:
        """(rows, persisted; when made; how many were wanted; how many there are), or None."""
        for made, wanted, n, name in self._entries(key):
            rows = None
            if time.time() - made / 1000 <= self.seconds:
                try:
                    rows = self.spark.read.parquet(f"{self.root}/{key}/{name}").persist()
                    if rows.count() == n:
                        return rows, made / 1000, wanted, n
                except (PySparkException, Py4JError):
                    pass
            if rows is not None:
                rows.unpersist()
            self._files.delete(self._path(f"{key}/{name}"), True)
        return None

    def put(self, key: str, rows: DataFrame, wanted: int, n: int) -> None:
        """Few rows, by the window of a search. Older results of the key go."""
        old = self._entries(key)
        aside = self._path(f".aside-{uuid.uuid4().hex}")
        rows.coalesce(1).write.parquet(aside.toString())
        self._files.mkdirs(self._path(key))
        self._files.rename(aside, self._path(f"{key}/{int(time.time() * 1000)}-{wanted}-{n}-{uuid.uuid4().hex}"))
        for *_, name in old:
            self._files.delete(self._path(f"{key}/{name}"), True)
