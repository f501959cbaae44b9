"""Shared results, metrics without jobs of their own, and labelling that remembers."""

import json
import logging
import re
import time

import numpy as np
import pytest

from corpusloom import constants as K
from corpusloom.functions.text import cache_key
from corpusloom.plans.results import ResultStore, result_key
from corpusloom.plans.service import SearchService
from corpusloom.streaming.labelling import label_stream


class Counted:
    dimension = 4

    def __init__(self):
        self.calls = 0

    def query(self, spark, text):
        self.calls += 1
        return [1.0, 0.5, 0.0, float(len(text))]


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"e{i % 5}", f"Title {i % 5}", "Part", f"u{i % 5}#s{i}", f"calm words {i}", [1.0, i / 7, 0.3, 1.0]) for i in range(60)], "chunk_id string, entry_slug string, entry_title string, section_title string, url string, chunk_text string, embedding array<float>")
    entries = spark.createDataFrame([(f"e{i}", f"Title {i}", "1. One", "words", [1.0, 0.1 * i, 0.0, 1.0]) for i in range(5)], "entry_slug string, entry_title string, section_outline string, intro_text string, embedding array<float>")
    return chunks.persist(), entries.persist()


def test_key_is_that_of_the_column(spark):
    from pyspark.sql import functions as F

    for limit in (1, 20):
        assert result_key("a b", limit) == spark.range(1).select(cache_key(F.lit("a b"), F.lit(limit))).first()[0]


def test_sessions_share_results(spark, tables, tmp_path):
    one, two = Counted(), Counted()
    first = SearchService(*tables, one, results=ResultStore(spark, f"file://{tmp_path}/r"))
    rows = first.search("calm words", result_limit=5).collect()
    other = spark.newSession()
    second = SearchService(*tables, two, results=ResultStore(other, f"file://{tmp_path}/r"))
    assert second.search("calm words", result_limit=5).collect() == rows and (one.calls, two.calls) == (1, 0)
    assert second.search("calm words", 20, result_limit=5).count() == 5 and two.calls == 1  # another key
    assert len([p for p in (tmp_path / "r" / result_key("calm words", None)).iterdir() if p.is_dir()]) == 1


def test_corrupt_and_expired_results_are_misses(spark, tables, tmp_path):
    def service(seconds=600.0):
        made = Counted()
        return SearchService(*tables, made, results=ResultStore(spark, f"file://{tmp_path}/r", seconds)), made

    service()[0].search("calm words")
    folder = tmp_path / "r" / result_key("calm words", None)
    for data in folder.glob("*/*.parquet"):
        data.write_bytes(data.read_bytes()[:100])
    for crc in folder.glob("*/.*.crc"):
        crc.unlink()
    again, made = service()
    assert again.search("calm words").count() == 7 and made.calls == 1
    kept, made = service()
    assert kept.search("calm words").count() == 7 and made.calls == 0  # the miss has put a good one in its place
    for entry in folder.iterdir():
        parts = entry.name.split("-")
        entry.rename(folder / "-".join([*parts[:2], "999", parts[3]]))
    torn, made = service()
    assert torn.search("calm words").count() == 7 and made.calls == 1
    late, made = service(0.01)
    time.sleep(0.1)
    assert late.search("calm words").count() == 7 and made.calls == 1


def test_metrics_cost_no_jobs(spark, tables, caplog):
    def jobs(metrics):
        group = f"metrics-{metrics}-{time.time()}"
        spark.sparkContext.setJobGroup(group, "")
        service = SearchService(*tables, Counted(), metrics=metrics)
        with caplog.at_level(logging.INFO, "corpusloom.search"):
            n = service.window("calm words", 14).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), service, n

    jobs(True)
    caplog.clear()
    (plain, *_), (watched, service, n) = jobs(False), jobs(True)
    assert watched <= plain
    assert service.stages == {"chunk_candidates": 60, "entries": 5, "expanded_chunks": 20, "merged": 60, "results": n} and n == 60
    (line,) = [json.loads(r.message) for r in caplog.records if r.name == "corpusloom.search"]
    assert line["rows"] == service.stages and line["retrieve_ms"] > 0


def test_each_slug_is_looked_up_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def lookup(slug):
        with open(f"{asked}/{slug}", "a") as f:
            f.write("x")
        if slug == "bad":
            raise OSError("no answer")
        return {"mind": '[{"topics": {"0": 0.6, "3": 0.2}}]', "weak": '[{"topics": {"0": 0.1}}]'}.get(slug)

    def run(ttl_ms=3_600_000, at="a"):
        pages = spark.readStream.schema("entry_slug string, metas array<string>, text string").parquet(f"file://{tmp_path}/in")
        label_stream(pages, lookup, f"file://{tmp_path}/out-{at}", f"file://{tmp_path}/cp-{at}", ttl_ms).awaitTermination()
        return sorted((r["entry_slug"], r["label"], r["source"], r["error"]) for r in spark.read.parquet(f"file://{tmp_path}/out-{at}").collect())

    def more(*rows):
        spark.createDataFrame(list(rows), "entry_slug string, metas array<string>, text string").write.mode("append").parquet(f"file://{tmp_path}/in")

    more(("ethics", ["Ethics"], ""), ("mind", [], "x"), ("mind", [], "x"), ("bad", None, None), (None, ["Logic"], "x"))
    first = [("bad", None, "error", "OSError: no answer"), ("ethics", "Ethics", "page", None), ("mind", "Philosophy of Mind", "topic", None)]
    assert run() == first
    more(("ethics", [], ""), ("mind", ["Logic"], ""), ("bad", [], ""), ("weak", [], ""), ("none", [], ""))
    assert run() == sorted([*first, ("weak", None, "none", None), ("none", None, "none", None)])
    assert {p.name: len(p.read_text()) for p in asked.iterdir()} == {"mind": 1, "bad": 1, "weak": 1, "none": 1}
    more(("mind", [], "again"))
    assert len(run()) == 5 and (asked / "mind").read_text() == "x"
    run(1, "b")
    time.sleep(0.2)
    more(("bad", [], "later"))
    run(1, "b")
    assert (asked / "bad").read_text() == "xxx"  # once by the first stream, twice by the one that forgets


def _tokens(text, drop=False):
    found = re.findall("[a-z0-9]+", re.sub(r"'s\b", "", text.lower()))
    return [t for t in found if not (drop and t in K.STOPWORDS)]


def _rerank(query, text):
    q = set(_tokens(query, True))
    return 8.0 * len(q & set(_tokens(text, True))) / len(q) - 4.0


def _title(query, title):
    q, t = _tokens(query, True), _tokens(title)
    while t and t[0] in ("a", "an", "the"):
        t = t[1:]
    both = " ".join(q), " ".join(t)
    phrase = 2.5 if both[0] == both[1] else (1.5 if len(t) > 1 else 1.0) if both[1] in both[0] else 0.0
    return phrase + 0.8 * len(set(q) & set(t)) / len(set(t)) + (0.6 if len(set(t)) > 1 and set(t) <= set(q) else 0.0)


def _section(query, section):
    q, s = _tokens(query, True), _tokens(section, True)
    return (0.4 * len(set(q) & set(s)) / len(set(s)) + (0.5 if len(s) > 1 and " ".join(s) in " ".join(q) else 0.0)) if s else 0.0


def _searched(query, vector, chunks, entries, wanted):
    """The ranking of a query, one row after another: (chunk_id, final)."""

    def cosine(v):
        a, b = np.array(v, np.float32).astype(float), np.array(vector, float)
        return a @ b / np.sqrt((a @ a) * (b @ b))

    n_chunks = max(24, 6 * wanted)
    n_entries = max(24, n_chunks, 4 * wanted)
    final = {}
    for slug, title, outline, intro, v in sorted(entries, key=lambda e: -cosine(e[4]))[:n_entries]:
        text = f"Entry: {title}\n\nSection headings:\n{outline}\n\nOverview:\n{intro}"
        final[slug] = _rerank(query, text) + cosine(v) + _title(query, title), cosine(v)
    taken = {c[0]: c for c in sorted(chunks, key=lambda c: -cosine(c[6]))[:n_chunks]}
    for slug in sorted(final, key=lambda s: (-final[s][0], -final[s][1], s))[:6]:
        taken |= {c[0]: c for c in sorted((c for c in chunks if c[1] == slug), key=lambda c: -cosine(c[6]))[:4]}
    ranked = []
    for name, slug, title, section, _, text, v in taken.values():
        rerank = _rerank(query, f"Entry: {title}\nSection: {section}\nPassage: {text}")
        parent = max(0.0, final[slug][0]) if slug in final else 0.0
        ranked.append((-(rerank + 0.75 * cosine(v) + 0.8 * parent + 0.35 * _title(query, title) + 0.2 * _section(query, section)), -cosine(v), name, rerank))
    ranked.sort()
    return [] if ranked[0][3] < -2.0 and -ranked[0][1] < 0.3 else [(name, -f) for f, _, name, _ in ranked]


def test_search_equals_the_rule(spark):
    """Candidates, expansion, merging, fusion, gate and pages against a plain loop over all rows."""
    rng = np.random.default_rng(11)
    words = "calm mind truth logic free will time causal moral law art language science faith proof state".split()
    some = lambda n: " ".join(rng.choice(words, n))
    titles = [("The " if i % 3 == 0 else "") + some(1 + i % 3).title() for i in range(60)]
    vectors = rng.standard_normal((60, 8)) + 5.0 * np.eye(8)[0]  # so that one query is far from all
    entries = [(f"e{i:02d}", titles[i], f"1. {some(2)}\n2. {some(3)}", some(12), (vectors[i] + 0.3 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(60)]
    chunks = [(f"c{i:03d}", f"e{i % 60:02d}", titles[i % 60], some(1 + i % 3), f"u{i % 60}#s{i}", some(9), (vectors[i % 60] + rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(420)]
    asked = {"the moral law of the mind's time": vectors[3], "free will": vectors[7] + 0.5 * vectors[9], "unheard words": vectors[5], "nothing of it": -np.eye(8)[0]}

    class Fixed:
        dimension = 8

        def query(self, spark, text):
            return asked[text].tolist()

    c = spark.createDataFrame(chunks, "chunk_id string, entry_slug string, entry_title string, section_title string, url string, chunk_text string, embedding array<float>").persist()
    e = spark.createDataFrame(entries, "entry_slug string, entry_title string, section_outline string, intro_text string, embedding array<float>").persist()
    service = SearchService(c, e, Fixed())
    for query, vector in asked.items():
        expected = _searched(query, vector.tolist(), chunks, entries, 6)
        window = service.window(query, 6).orderBy("rank").select("chunk_id", "final").collect()
        assert [r["chunk_id"] for r in window] == [name for name, _ in expected]
        assert [r["final"] for r in window] == pytest.approx([f for _, f in expected])
        assert len(window) == 0 if query == "nothing of it" else len(window) > 36
    by_text = {c[0]: c[5] for c in chunks}
    expected = _searched("free will", asked["free will"].tolist(), chunks, entries, 9)  # of two pages of 3, and one ahead
    assert [r["chunk_text"] for r in service.search("free will", result_limit=3, offset=3).collect()] == [by_text[name] for name, _ in expected[3:6]]
