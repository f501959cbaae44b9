import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.functions import models
from corpusloom.operators import chunking, classify, graph, retrieval
from corpusloom.plans import build, service
from corpusloom.plans.evaluate import evaluate
from corpusloom.plans.service import GraphService, SearchService, create_search_service, payload, write_payload
from corpusloom.sources import html, json_array, snapshots, store


def sentence(n, end="."):
    return " ".join(["Word"] * (n - 1) + ["end" + end])


@pytest.mark.parametrize(("sizes", "chunks"), [([200, 250], [450]), ([120, 200, 150, 90, 380, 40], [320, 240, 380, 40]), ([400], [400]), ([1], [1]), ([300, 101], [300, 101])])
def test_paragraph_packing(sizes, chunks):
    assert [len(c.split()) for c in chunking.base_chunks("\n\n".join(sentence(n) for n in sizes))] == chunks


def test_oversize():
    assert [len(c.split()) for c in chunking.base_chunks(sentence(900))] == [350, 350, 200]
    assert [len(c.split()) for c in chunking.base_chunks(" ".join([sentence(100)] * 9))] == [400, 400, 100]
    assert chunking.base_chunks("") == [] and chunking.base_chunks(None) == []
    words = [w for c in chunking.base_chunks("\n\n".join([sentence(350), sentence(500), sentence(20)])) for w in c.split()]
    assert len(words) == 870


def test_overlap(spark):
    text = "\n\n".join([sentence(300), sentence(81), sentence(350)])
    rows = chunking.chunk_sections(spark.createDataFrame([("e", text), ("f", ""), ("g", None)], "slug string, section_text string"), ["slug"]).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == [0, 1] and len({r["chunk_id"] for r in rows}) == 2
    assert len(rows[1]["chunk_text"].split("\n\n")[0].split()) == 40  # a long last sentence gives its last words


def test_gate_and_pages(spark):
    def rows(rerank, cosine):
        return spark.createDataFrame([(1, rerank, cosine), (2, 9.0, 0.9)], "rank int, rerank double, cosine double")

    assert retrieval.confident(rows(-2.0, 0.29)).count() == 2
    assert retrieval.confident(rows(-2.1, 0.3)).count() == 2
    assert retrieval.confident(rows(-2.1, 0.29)).count() == 0
    assert [r["rank"] for r in retrieval.page(rows(1.0, 1.0), 1, 5).collect()] == [2]
    assert retrieval.budgets(7) == (42, 42) and retrieval.budgets(3, 20) == (20, 24) and retrieval.widened(7, 7) == 14
    with pytest.raises(ValueError):
        retrieval.page(rows(1.0, 1.0), -1, 5)


def test_thinning_is_the_sequential_rule(spark):
    r = random.Random(4)
    edges = [(a, b, round(r.random(), 2)) for a in range(16) for b in range(a + 1, 16) if r.random() < 0.6]
    rows = spark.createDataFrame([(a, b, s, s + (2 if 7 in (a, b) else 0)) for a, b, s in edges], "src long, dst long, similarity double, score double")
    for budget, cap in ((60, 3), (12, 4)):
        used, left = {}, []
        for a, b, s, score in sorted(((a, b, s, s + (2 if 7 in (a, b) else 0)) for a, b, s in edges), key=lambda e: (e[3], e[2], e[0], e[1]), reverse=True):
            if all(used.get(x, 0) < cap * (2 if x == 7 else 1) for x in (a, b)) and len(left) < budget:
                left.append((a, b))
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
        found = graph.thinned_edges(rows, budget, cap, 7).select("src", "dst").collect()
        assert len(edges) > budget and sorted(map(tuple, found)) == sorted(left)
    assert graph.thinned_edges(rows, 10_000, 1).count() == len(edges)
    assert graph.edge_budget(100, True) == (7000, 12) and graph.edge_budget(2000, False) == (18000, 18)


def test_explicit_edges(spark):
    rows = [(0, "a", ["b", "c"], {"b": 2, "zz": 1, "a": 5}), (1, "a", ["c"], {"c": 9}), (0, "b", ["a", "a", "c"], None)]
    sections = spark.createDataFrame(rows, "section_ord int, entry_slug string, outbound_links array<string>, outbound_link_counts map<string,int>")
    edges, skipped = graph.explicit_edges(sections, spark.createDataFrame([("a",), ("b",), ("c",)], "slug string"))
    assert sorted(map(tuple, edges.collect())) == [("a", "b", 2), ("b", "a", 1), ("b", "c", 1)]
    assert [tuple(r) for r in skipped.collect()] == [("a", "zz", 1)]


def test_explicit_edges_groups_entries_only(spark):
    """Keys that become one do so within a map; no task holds all links of its entries in a hash table."""
    good, once, twice = "caf\u00e9", "caf\u00c3\u00a9", "caf\u00c3\u0083\u00c2\u00a9"
    rows = [(0, "a", None, {good: 1, once: 7, twice: 3, "b": 2}), (0, "b", None, {once: 1, good: None, "\u00e2": 4}), (0, once, [good, once, "a"], None), (0, "c", None, {}), (0, "d", None, None), (0, "z", ["a"], None)]
    sections = spark.createDataFrame(rows, "section_ord int, entry_slug string, outbound_links array<string>, outbound_link_counts map<string,int>")
    edges, skipped = graph.explicit_edges(sections, spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", good)], "slug string"))
    assert sorted(map(tuple, edges.collect())) == [("a", "b", 2), ("a", good, 7), ("b", good, 1), (good, "a", 1)]
    assert [tuple(r) for r in skipped.collect()] == [("b", "\u00e2", 4)]
    for df in (edges, skipped):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_graph_service(spark):
    entries = spark.createDataFrame([(x, x.upper()) for x in "abcde"], "entry_slug string, entry_title string")
    explicit = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("a", "c", 1), ("a", "d", 1), ("c", "d", 1)], "src string, dst string, weight int")
    semantic = spark.createDataFrame([("a", "b", 0.9), ("d", "e", 0.95)], "src string, dst string, similarity double")
    service = GraphService(entries, explicit, semantic)
    assert [r["slug"] for r in service.get_full_graph()["nodes"].collect()] == ["a"]
    near = service.get_neighborhood("a", 1)
    assert [(r["slug"], r["degree"]) for r in near["nodes"].collect()] == [("a", 3), ("c", 2), ("d", 2), ("b", 1)]
    assert near["explicit_edges"].count() == 5 and near["semantic_edges"].count() == 1
    assert service.get_neighborhood("b", 2)["nodes"].count() == 4
    with pytest.raises(LookupError):
        service.get_neighborhood("nobody")
    with pytest.raises(ValueError):
        service.get_neighborhood("a", 3)


PAGE = """<html><head><title>T &amp; U</title><meta property="citation_title" content=" On  Truth "></head><body><div id="preamble"><p>Lead.</p></div>
<div id="main-text"><p>before</p><h2><a id="one">1. First</a></h2><p>A <a href="../logic/">b</a></p><ul><li>x</li><li>y</li></ul><div><h2>inner</h2>z</div>
<h3 id="two">1.1 Second</h3><table><tr><th>a</th><td>b</td></tr><tr><td></td></tr></table><dl><dt>t</dt><dd>d</dd></dl><a href="/entries/logic/#q">c</a><h4>Empty</h4></div></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([("http://h.org/entries/truth/", PAGE), ("http://h.org/entries/x/", "<title>X</title><div id='main-text'>t<p>only</p></div>"), ("http://h.org/entries/y/", None)], "url string, html string")
    parsed = html.parse_pages(pages)
    assert [(r["title"], r["lead"], r["found"]) for r in parsed.orderBy("url").collect()] == [("On Truth", "Lead.", True), ("X", "only", True), (None, "", False)]
    rows = [tuple(r) for r in html.page_sections(parsed).orderBy("url").select("section_number", "section_title", "section_text", "url").collect()]
    assert rows == [
        ("1", "First", "A b\n\nx\ny\n\ninner z", "http://h.org/entries/truth/#one"),
        ("1.1", "Second", "a | b\n\nt\nd\n\nc", "http://h.org/entries/truth/#two"),
        ("", "Main Text", "only", "http://h.org/entries/x/"),
    ]
    assert [tuple(r) for r in html.link_counts(parsed).collect()] == [("truth", "logic", 2)]
    links = parsed.select(F.posexplode("hrefs").alias("pos", "href"))
    assert [r["url"] for r in html.listed_entries(links).collect()] == ["http://h.org/entries/logic/"]


def test_labels(spark):
    def label(payload):
        return spark.range(1).select(classify.topic_label(F.lit(payload)).alias("x")).first()["x"]

    assert label('[{"topics":{"3":0.15,"4":0.15}}]') == K.TOPIC_LABELS["3"]
    assert label('[{"topics":{"3":0.149}}]') is None and label("[]") is None and label('[{"topics":{}}]') is None and label('[{"topics":{"77":0.9}}]') is None
    page = lambda metas, text: spark.range(1).select(classify.page_label(F.array(*map(F.lit, metas)), F.lit(text)).alias("x")).first()["x"]
    assert page(["x", "Ethics"], "Category: logic") == "Ethics"
    assert page(["x"], "Area: ethics. Category: logic") == "Logic"
    assert page(["x"], "Category: logic and more") is None


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    assert snapshots.load(rows((1, "a"), (2, "b")), path, ["k"]) == 2
    assert snapshots.load(rows((2, "c"), (3, "d")), path, ["k"], dry_run=True) == 2
    snapshots.load(rows((2, "c"), (3, "d")), path, ["k"])
    assert sorted(map(tuple, snapshots.Snapshots(spark, path).read("rows").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    (tmp_path / "r.json").write_text('[{"a": "Ã©", "l": ["Ã©"]}, {"a": "x", "l": []}]')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("l", T.ArrayType(T.StringType()))])
    read = json_array.read_records(spark, f"file://{tmp_path}/r.json", schema)
    assert [tuple(r) for r in store.repair_records(read).orderBy("section_ord").collect()] == [(0, "é", ["é"]), (1, "x", [])]
    assert json_array.read_records(spark, f"file://{tmp_path}/r.json", schema, limit=1).count() == 1
    (tmp_path / "bad.json").write_text("[]")
    with pytest.raises(ValueError):
        json_array.read_records(spark, f"file://{tmp_path}/bad.json", schema)
    assert store.database_url({"POSTGRES_DB": "d", "POSTGRES_USER": "u", "POSTGRES_PASSWORD": "p@ss"}) == "postgresql://u:p%40ss@localhost:5432/d"


def test_stream(spark, tmp_path):
    from corpusloom.streaming.ingest import upsert_stream

    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k int, v string").parquet(f"file://{tmp_path}/in")
    upsert_stream(stream, f"file://{tmp_path}/out", ["k"], f"file://{tmp_path}/cp").awaitTermination()
    assert snapshots.Snapshots(spark, f"file://{tmp_path}/out").read("rows").count() == 2


def test_build_search_and_report(spark):
    def page(slug, other, text):
        return f"http://h.org/entries/{slug}/", f"<title>{slug.title()}</title><div id='main-text'><h2>1. {text}</h2><p>{text} of {slug}. See <a href='/entries/{other}/'>that</a>.</p></div>"

    pages = spark.createDataFrame([page("truth", "logic", "Correspondence"), page("logic", "truth", "Inference"), page("mind", "nobody", "Consciousness")], "url string, html string")
    made = build.build(pages, threshold=-1.0)
    assert sorted(map(tuple, made["explicit_edges"].select("src", "dst", "weight").collect())) == [("logic", "truth", 1), ("truth", "logic", 1)]
    assert made["semantic_edges"].count() == 3 and made["entries"].count() == 3
    service = SearchService(made["chunks"].persist(), made["entries"].persist())
    assert service.search("correspondence of truth").first()["entry_title"] == "Truth"
    assert [len(p) for p in service.pages("truth", 2)] == [2, 1]
    for bad in ("", " ", "x" * 301):
        with pytest.raises(ValueError):
            service.search(bad)
    assert set(service.stages) == {"chunk_candidates", "entries", "expanded_chunks", "merged", "results"} and all(n > 0 for n in service.stages.values())
    service.search("truth", candidate_limit=20), service.search("truth", candidate_limit=100)
    assert {("truth", 20), ("truth", 100)} <= set(service.cache)
    assert "Query: truth" in evaluate(service, ["truth"])
    assert SearchService(made["chunks"], None).search("inference").count() > 0


def test_missing_entries_and_payload(spark, tmp_path):
    chunks = spark.createDataFrame([("c", "e", "T", "S", "u", "calm words", [1.0] * 64)], "chunk_id string, entry_slug string, entry_title string, section_title string, url string, chunk_text string, embedding array<double>")
    chunks.write.parquet(f"{tmp_path}/chunks")
    assert create_search_service(spark, f"{tmp_path}/chunks", f"{tmp_path}/none").search("calm words").count() == 1
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "entry_slug string, entry_title string")
    edges = spark.createDataFrame([("a", "b", 2)], "src string, dst string, weight int")
    service = GraphService(nodes, edges, edges.select("src", "dst", F.lit(0.9).alias("similarity")), spark.createDataFrame([("a", " The  lead. ")], "entry_slug string, lead string"))
    view = json.loads(payload(service.get_neighborhood("a")))
    assert {r["slug"]: r.get("lead") for r in view["nodes"]} == {"a": "The lead.", "b": None} and view["explicit_edges"] == [{"src": "a", "dst": "b", "weight": 2}]
    near = service.get_neighborhood("a")
    with pytest.raises(ValueError, match="nodes has more than 1 rows"):
        payload(near, 1)
    write_payload(near, f"file://{tmp_path}/view")
    for part, rows in view.items():
        lines = [line for file in sorted((tmp_path / "view" / part).glob("*.txt")) for line in file.read_text().splitlines()]
        assert [json.loads(line) for line in lines] == rows
    assert service.health() == {"entries": 2, "explicit_edges": 1, "semantic_edges": 1}


def test_models_are_loaded_once_a_worker(spark):
    rows = spark.createDataFrame([("a bc",), (None,)], "text string")
    embed = models.LoadedEmbedder(lambda: lambda texts: [[len(t), t.count(" ")] for t in texts], 2)
    assert [list(r[0]) for r in rows.select(embed.column(F.col("text"))).collect()] == [[4.0, 1.0], [0.0, 0.0]] and embed.query(spark, "x y") == [3.0, 1.0]
    rank = models.LoadedReranker(lambda: lambda pairs: [len(q) - len(t) for q, t in pairs])
    assert [r[0] for r in rows.select(rank.column(F.lit("ab"), F.col("text"))).collect()] == [-2.0, 2.0]


def test_store_is_repeatable_and_repairs_deeply(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b"), (1, "c"), (1, "a"), (2, "x")], "k int, v string")
    held = snapshots.Snapshots(spark, f"{tmp_path}/t")
    assert snapshots.load(rows, held.root, ["k"]) == 4
    assert sorted(map(tuple, held.read("rows").collect())) == [(1, "c"), (2, "x")]
    snapshots.load(rows.limit(0).union(spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string")), held.root, ["k"])
    assert sorted(map(tuple, held.read("rows").collect())) == [(1, "c"), (2, "y"), (3, "z")]
    snapshots.load(rows, held.root, ["k"], truncate=True)
    assert held.read("rows").count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
    bad = "Ã©"
    deep = spark.createDataFrame([([{"m": {"k": bad}}],)], "d array<struct<m:map<string,string>>>")
    assert store.repair_records(deep).first()["d"][0]["m"]["k"] == "é"
    store.write_records(rows, f"{tmp_path}/lines")
    assert store.read_lines(spark, f"{tmp_path}/lines", rows.schema).count() == 4


def test_link_in_the_preferred_block(spark):
    a = '<p><a href="/x?entry=first">x</a></p><div id="academic-tools"><a href="/other">o</a><a href="https://i.org/entity?p=1&entry=mind%20x">i</a></div>'
    rows = [(1, a), (2, '<a href="/e?entry=only">x</a>'), (3, '<a href="/e?q=1">x</a>'), (4, None), (5, '<a href="/e?entry=">x</a><div id="academic-tools"></div>')]
    found = html.linked_parameter(spark.createDataFrame(rows, "page_id int, html string"), "entry=", "entry").collect()
    got = {r["page_id"]: r["linked"] for r in found}
    assert got[2] == "only" and got[3] is None and got[4] is None and got[5] is None and got[1].startswith("mind")


def test_categories(spark, tmp_path):
    config = {"default_color": "#000", "legend_order": ["B", "A"], "subdiscipline_colors": {"A": "#a", "B": "#b", "C": "#c"}, "aliases": {"Aye": "A"}, "inpho_topic_model": {"k": 2, "min_topic_probability": 0.2, "topic_to_subdiscipline": {"0": "B", "1": "C"}}}

    def read(**change):
        (tmp_path / "c.json").write_text(json.dumps({k: v for k, v in (config | change).items() if v is not None}))
        return classify.read_categories(spark, f"file://{tmp_path}/c.json")

    c = read()
    rows = spark.createDataFrame([(["aye"], "", None), ([], "", '[{"topics": {"1": 0.3}}]'), ([], "", '[{"topics": {"1": 0.1}}]')], "m array<string>, t string, p string")
    found = rows.select(c.resolved(F.col("m"), F.col("t"), F.col("p")).alias("r")).select("r.*", c.color(F.col("r.label")).alias("color"))
    assert [tuple(r) for r in found.collect()] == [("A", "page", "#a"), ("C", "topic", "#c"), (None, "none", "#000")]
    assert [tuple(r) for r in c.legend(spark.createDataFrame([("C",), ("A",), ("B",), ("A",), (None,)], "label string")).orderBy("place").collect()] == [(1, "B", "#b"), (2, "A", "#a"), (3, "C", "#c")]
    for change in ({"aliases": None}, {"inpho_topic_model": {"k": 2}}, {"inpho_topic_model": config["inpho_topic_model"] | {"k": 3}}, {"legend_order": ["Z"]}):
        with pytest.raises(ValueError, match="no "):
            read(**change)


def test_payload_is_checked(spark):
    nodes = spark.createDataFrame([("a", "A", 1)], "slug string, entry_title string, degree long")
    edges = spark.createDataFrame([("a", "b", 2)], "src string, dst string, weight int")
    good = {"nodes": nodes, "explicit_edges": edges, "semantic_edges": edges.select("src", "dst", F.lit(0.5).alias("similarity"))}
    service.check_payload(good)
    with pytest.raises(ValueError, match="explicit_edges.weight is bigint, not int; no semantic_edges"):
        service.check_payload({"nodes": nodes, "explicit_edges": edges.withColumn("weight", F.lit(2).cast("long"))})
    with pytest.raises(ValueError, match="nodes.degree is missing"):
        payload(good | {"nodes": nodes.drop("degree")})
