"""Versioned tables in one folder, published together by one pointer.

A commit writes new Parquet folders beside the old ones, then a pointer file under a temporary name, and renames that to the
next version's name: this one step publishes all its tables at once. A reader takes the newest pointer and keeps reading
its folders, which nobody changes. Whatever is left by a writer that died before the rename is never seen. The pointer also
remembers, for each stream, the last micro-batch that a commit holds, so that a replayed batch changes nothing.

Layout under the root: versions/00000012.json, data/<folder>.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .store import last_rows, upsert


class Conflict(RuntimeError):
    """Another writer has published this version first."""


class Snapshots:
    """after(step) is called when each step of a commit is done ("data", "pointer", "published", "vacuumed"), for tests that stop between them."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2, after: Callable[[str], None] = lambda step: None):
        self.spark, self.root, self.keep, self.after = spark, root.rstrip("/"), keep, after
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(path)) if self._files.exists(path) else []

    def _versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def pointer(self, version: int | None = None) -> dict:
        """{"version", "tables": {name: folder}, "batches": {stream: id}} of a version, the newest by default; version 0 has nothing."""
        version = max(self._versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "batches": {}}
        read = self._files.open(self._path(f"versions/{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(read, "UTF-8")
        finally:
            read.close()
        return json.loads(text)

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version; None where that has none."""
        folder = self.pointer(version)["tables"].get(table)
        return None if folder is None else self.spark.read.parquet(f"{self.root}/data/{folder}")

    def commit(self, tables: dict[str, DataFrame], base: dict | None = None, batches: dict[str, int] | None = None) -> int:
        """Publishes these tables in place of those of the same names, all at once; the others stay. The new version.

        base: the pointer that the new tables were made from; another version published since is a Conflict.
        """
        base = self.pointer() if base is None else base
        folders = {}
        for name, df in tables.items():
            folders[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/data/{folders[name]}")
        self.after("data")
        version = base["version"] + 1
        new = {"version": version, "tables": base["tables"] | folders, "batches": base["batches"] | (batches or {})}
        draft, name = self._path(f"versions/.draft-{uuid.uuid4().hex}"), self._path(f"versions/{version:08d}.json")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        self.after("pointer")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        try:  # unlike FileSystem.rename, this one never replaces a file
            context.rename(draft, name, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                self._files.delete(draft, False)
                raise Conflict(f"version {version} of {self.root} is there already") from e
            raise
        self.after("published")
        self.vacuum()
        self.after("vacuumed")
        return version

    def vacuum(self) -> None:
        """Drops all but the newest `keep` versions and the folders that only dropped versions name. Folders of unpublished commits stay for sweep()."""
        versions = sorted(self._versions())
        old, kept = versions[: -self.keep], versions[-self.keep :]
        named = {f for v in kept for f in self.pointer(v)["tables"].values()}
        for v in old:
            for folder in set(self.pointer(v)["tables"].values()) - named:
                self._files.delete(self._path(f"data/{folder}"), True)
            self._files.delete(self._path(f"versions/{v:08d}.json"), False)

    def sweep(self) -> int:
        """Drops what dead writers have left; only while no other writer is at work. How many folders and drafts."""
        named = {f for v in self._versions() for f in self.pointer(v)["tables"].values()}
        left = [f"data/{f}" for f in self._names("data") if f not in named] + [f"versions/{f}" for f in self._names("versions") if f.startswith(".draft-")]
        for name in left:
            self._files.delete(self._path(name), True)
        return len(left)

    def upsert(self, table: str, new: DataFrame, keys: list[str], order: str | None = None, truncate: bool = False, batch: tuple[str, int] | None = None) -> int | None:
        """Puts the rows of new in place of those with their keys, of several with one key the last by the column `order`; with
        truncate, they replace the table. batch (stream, id): nothing happens, and None is returned, if that batch is in already."""
        base = self.pointer()
        if batch is not None and base["batches"].get(batch[0], -1) >= batch[1]:
            return None
        old = None if truncate or table not in base["tables"] else self.read(table, base["version"])
        rows = last_rows(new, keys, order) if old is None else newer(old, new, keys, order)
        return self.commit({table: rows}, base, dict([batch]) if batch else None)


def newer(old: DataFrame, new: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """old with the rows of new; with an order column a row that came late does not replace one that is after it."""
    if order is None:
        return upsert(old, new, keys)
    return last_rows(old.unionByName(new.select(*old.columns)), keys, order)


def load(new: DataFrame, root: str, keys: list[str], table: str = "rows", truncate: bool = False, dry_run: bool = False, order: str | None = None) -> int:
    """Upserts new into a table of the snapshots at root (replaces it with truncate); dry_run only counts. The number of new rows."""
    n = new.count()
    if not dry_run:
        Snapshots(new.sparkSession, root).upsert(table, new, keys, order, truncate)
    return n


def reload_edges(root: str, explicit: DataFrame, semantic: DataFrame, dry_run: bool = False) -> tuple[int, int]:
    """Replaces both edge tables (src, dst, weight or similarity) at once, so that no reader sees one without the other. Their rows."""
    made = {name: last_rows(df, ["src", "dst"]) for name, df in (("explicit_edges", explicit), ("semantic_edges", semantic))}
    if dry_run:
        return tuple(df.count() for df in made.values())
    snapshots = Snapshots(explicit.sparkSession, root)
    snapshots.commit(made)
    return tuple(snapshots.read(name).count() for name in made)
