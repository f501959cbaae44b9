"""Archived web pages as a Spark data source: WARC files (ISO 28500), plain or gzipped, to pages(page_id, url, html).

    register(spark)
    pages = spark.read.format("page_archive").option("limit", 1000).load("file:///archive/*.warc")

A plain file is cut into byte ranges, each one a task that begins at the first record that starts in it; a gzipped one is one
task. Bodies are decoded by the charset of the HTTP header, else of a byte order mark, else of the page's own meta element, else as UTF-8, else as Windows-1252.
Options: rangeBytes, limit (the first pages, by file and place) and statuses (of the HTTP answers that are pages, 200 by default).
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RANGE_BYTES = 64 << 20

_START = b"WARC/1."
_META = re.compile(rb"<meta[^>]*charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_HEADER = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_MARKS = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}


def decoded(body: bytes, content_type: str = "") -> str:
    """The text of a page, by the first charset that is named and fits; bytes that no charset fits become U+FFFD."""
    named = [m[1] for m in [_HEADER.search(content_type)] if m]
    named += [c for mark, c in _MARKS.items() if body.startswith(mark)]
    named += [m[1].decode("ascii") for m in [_META.search(body[:4096])] if m]
    for charset in [*named, "utf-8", "windows-1252"]:
        try:
            return body.decode(charset)
        except (UnicodeDecodeError, LookupError):
            continue
    return body.decode("windows-1252", "replace")


def _headers(file) -> dict[str, str] | None:
    """The header lines up to an empty one, names in lower case; None at the end of the file."""
    found: dict[str, str] = {}
    first = file.readline()
    while first in (b"\r\n", b"\n"):
        first = file.readline()
    if not first:
        return None
    found[""] = first.decode("latin-1").strip()
    while (line := file.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("latin-1").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _unchunked(body: bytes) -> bytes:
    file, out = io.BytesIO(body), []
    while (size := file.readline().split(b";")[0].strip()) and (n := int(size, 16)):
        out.append(file.read(n))
        file.readline()
    return b"".join(out)


def page_of(warc: dict[str, str], content: bytes, statuses: frozenset[int]) -> tuple[str, str] | None:
    """(url, html) of a record; None if it isn't a page."""
    if warc.get("warc-type") != "response" or not warc.get("warc-target-uri"):
        return None
    file = io.BytesIO(content)
    http = _headers(file)
    status = (http or {}).get("", "").split(" ")[1:2]
    if not status or not status[0].isdigit() or int(status[0]) not in statuses:
        return None
    kind = http.get("content-type", "text/html")
    if not re.match(r"(?i)\s*(text/html|application/xhtml\+xml)", kind):
        return None
    body = file.read()
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    if (coding := http.get("content-encoding", "").lower()) in ("gzip", "x-gzip", "deflate"):
        body = zlib.decompress(body, 47 if "gzip" in coding else 15)
    return warc["warc-target-uri"].strip("<>"), decoded(body, kind)


@dataclass
class _Range(InputPartition):
    number: int  # of the file
    path: str
    start: int
    end: int | None  # None: to the end of the file
    most: int | None = None


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("the page archive has no path")
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.limit = int(options["limit"]) if "limit" in options else None
        if self.size < 1 or (self.limit is not None and self.limit < 1):
            raise ValueError("rangeBytes and limit must be positive")
        self.statuses = frozenset(int(s) for s in options.get("statuses", "200").split(","))

    def _files(self) -> list[tuple[str, int]]:
        """(path, size) of the files that the path names: a file, a folder, or a folder and a pattern of names."""
        folder, _, name = self.path.rpartition("/")
        pattern = re.compile(re.escape(name).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")) if re.search(r"[*?]", name) else None
        files, inner = pafs.FileSystem.from_uri(folder if pattern else self.path) if "://" in self.path else (pafs.LocalFileSystem(), folder if pattern else self.path)
        info = files.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(inner))
        prefix = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")) and (pattern is None or pattern.fullmatch(f.base_name)))

    def partitions(self) -> list[_Range]:
        ranges = []
        for i, (path, size) in enumerate(self._files()):
            step = size or 1 if path.endswith(".gz") else self.size
            ranges += [_Range(i, path, at, at + step) for at in range(0, size, step)]
        if self.limit is None:
            return ranges
        kept, left = [], self.limit  # a small number: its pages are counted here, in order, until there are enough
        for r in ranges:
            n = sum(1 for _ in zip(range(left), self._pages(r), strict=False))
            kept.append(_Range(r.number, r.path, r.start, r.end, n))
            left -= n
            if not left:
                break
        return kept

    def _pages(self, part: _Range) -> Iterator[tuple[int, str, str]]:
        files, inner = pafs.FileSystem.from_uri(part.path) if "://" in part.path else (pafs.LocalFileSystem(), part.path)
        with files.open_input_file(inner) as raw:
            if part.path.endswith(".gz"):
                file, at = io.BufferedReader(gzip.GzipFile(fileobj=raw)), 0
            else:
                at = _first_record(raw, part.start, part.end)
                if at is None:
                    return
                raw.seek(at)
                file = io.BufferedReader(_Raw(raw), 1 << 20)
            while part.path.endswith(".gz") or at < part.end:
                at = file.tell()
                warc = _headers(file)
                if warc is None or (not part.path.endswith(".gz") and at >= part.end):
                    return
                if not warc[""].startswith("WARC/1."):
                    raise ValueError(f"{part.path}: no record at {at}")
                content = file.read(int(warc["content-length"]))
                file.read(4)
                if page := page_of(warc, content, self.statuses):
                    yield (part.number << 44) + at, *page

    def read(self, part: _Range) -> Iterator[tuple[int, str, str]]:
        for i, page in enumerate(self._pages(part)):
            if part.most is not None and i >= part.most:
                return
            yield page


class _Raw(io.RawIOBase):
    """A file of pyarrow as one that BufferedReader takes."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        return self.file.seek(at, whence)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)


def _first_record(file, start: int, end: int) -> int | None:
    """Where the first record of [start, end) begins: its header is whole, and behind its content another record begins, or nothing."""
    if start == 0:
        return 0
    size, at, block = file.size(), start - 4, 1 << 20
    while at < end:
        file.seek(at)
        data = file.read(block + 11)
        for m in re.finditer(rb"\r\n\r\n(?=WARC/1\.)", data):
            here = at + m.end()
            if here >= end:
                return None
            if here >= start and _is_record(file, here, size):
                return here
        if len(data) < block + 11:
            return None
        at += block
    return None


def _is_record(file, at: int, size: int) -> bool:
    file.seek(at)
    headers = _headers(io.BytesIO(file.read(1 << 16)))
    length = (headers or {}).get("content-length", "")
    if not length.isdigit() or "warc-type" not in headers:
        return False
    file.seek(at)
    head = file.read(1 << 16).find(b"\r\n\r\n")
    after = at + head + 4 + int(length)
    file.seek(min(after, size))
    rest = file.read(4 + len(_START))
    return head >= 0 and (rest.strip() == b"" and after <= size or rest == b"\r\n\r\n" + _START)


class PageArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return "page_id long, url string, html string"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageArchive)
