"""The page archive source, and the order in which pages are first listed."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import html, page_archive


def record(url, body, http="Content-Type: text/html", status="200 OK", kind="response"):
    content = f"HTTP/1.1 {status}\r\n{http}\r\n\r\n".encode() + body
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n"


TEXT = "Thé naïve “quote” – fin"
CHARSETS = [
    ("header", TEXT.encode("windows-1252"), "Content-Type: text/html; charset=windows-1252", TEXT),
    ("meta", b'<meta charset="iso-8859-15">' + "10 € é".encode("iso-8859-15"), "Content-Type: text/html", '<meta charset="iso-8859-15">10 € é'),
    ("utf8", ("<p>" + TEXT + " 日本").encode(), "Content-Type: text/html", "<p>" + TEXT + " 日本"),
    ("mark", "﻿<p>ü".encode("utf-16"), "Content-Type: text/html", None),
    ("wrong", TEXT.encode("windows-1252"), "Content-Type: text/html; charset=utf-8", TEXT),
    ("unknown", "é".encode(), "Content-Type: text/html; charset=x-none", "é"),
    ("bytes", b"a\x81b", "Content-Type: text/html; charset=utf-8", "a�b"),
    ("zipped", gzip.compress("é".encode()), "Content-Type: text/html\r\nContent-Encoding: gzip", "é"),
    ("deflated", zlib.compress(b"d"), "Content-Type: text/html\r\nContent-Encoding: deflate", "d"),
    ("chunked", b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n", "Content-Type: text/html\r\nTransfer-Encoding: chunked", "abcde"),
]


@pytest.fixture(scope="module")
def read(spark):
    page_archive.register(spark)
    return lambda path, **o: spark.read.format("page_archive").options(**o).load(str(path))


def test_charsets_and_what_is_no_page(read, tmp_path):
    data = b"".join(record(f"http://x.org/{n}", b, h) for n, b, h, _ in CHARSETS)
    data += record("http://x.org/gone", b"no", status="404 Not Found") + record("http://x.org/img", b"\x89PNG", "Content-Type: image/png") + record("http://x.org/asked", b"", kind="request") + record("http://x.org/empty", b"")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(f"http://x.org/z{i}", b"z")) for i in range(3)))
    (tmp_path / "other.txt").write_text("no archive")
    rows = {r["url"]: r["html"] for r in read(f"file://{tmp_path}/*.warc*").collect()}
    assert all(rows[f"http://x.org/{n}"] == text for n, _, _, text in CHARSETS if text is not None)
    assert rows["http://x.org/mark"].lstrip("﻿") == "<p>ü" and rows["http://x.org/empty"] == ""
    assert rows.keys() == {f"http://x.org/{n}" for n, *_ in CHARSETS} | {"http://x.org/empty"} | {f"http://x.org/z{i}" for i in range(3)}
    assert [r["url"] for r in read(f"{tmp_path}/a.warc", statuses="404").collect()] == ["http://x.org/gone"]


def test_ranges_and_limit(read, tmp_path):
    tricky = b"\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://fake\r\nContent-Length: 5\r\n\r\n"
    pages = [(f"http://x.org/{i}", tricky * (i % 3) + b"y" * (i * 7 % 400)) for i in range(150)]
    for k in range(2):
        (tmp_path / f"{k}.warc").write_bytes(b"".join(record(u, b) for u, b in pages[k * 75 : k * 75 + 75]))
    whole = read(tmp_path).orderBy("page_id").collect()
    assert [(r["url"], r["html"].encode()) for r in whole] == pages
    cut = read(tmp_path, rangeBytes="700")
    assert cut.rdd.getNumPartitions() > 40 and cut.orderBy("page_id").collect() == whole
    assert read(tmp_path, rangeBytes="700", limit="90").orderBy("page_id").collect() == whole[:90]
    assert read(tmp_path, limit="1000").count() == 150
    with pytest.raises(Exception, match="positive"):
        read(tmp_path, limit="0").collect()


def test_places(spark):
    hrefs = spark.createDataFrame([(i, f"https://x.org/entries/e{(i * 7) % 90}/#s{i}") for i in range(300)] + [(300, "https://x.org/about")], "pos int, href string").repartition(7)
    found = html.listed_entries(hrefs).orderBy("place").collect()
    assert [r["url"] for r in found] == [f"https://x.org/entries/e{(i * 7) % 90}/" for i in range(90)] and [r["place"] for r in found] == list(range(1, 91))
    assert [r["place"] for r in html.listed_entries(hrefs, 5).orderBy("place").collect()] == [1, 2, 3, 4, 5]
    plan = html.placed(hrefs, "pos").select("place")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the sizes of the ranges
    assert html.placed(hrefs.filter(F.lit(False)), "pos").count() == 0
