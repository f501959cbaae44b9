"""HTML pages: character references."""

from corpusloom.sources import html


def test_only_whole_references_stand_for_characters(spark):
    page = "<title>a &amp;&amp</title><article><h1>b &lt;&lt</h1><p>&quot; &quot &notit; &#65; &#65 ﷐+ &</p><a href='/x?a=1&copy=2&amp;b'>l</a></article>"
    row = html.parse_pages(spark.createDataFrame([("http://h.org/", page)], "url string, html string"), "article", headings=["h1"]).first()
    assert row["title"] == "a &&amp" and row["hrefs"] == ["http://h.org/x?a=1&copy=2&b"]
    assert [(s["heading"], s["text"]) for s in row["sections"]] == [("b <&lt", '" &quot &notit; A &#65 ﷐+ &\n\nl')]


def test_scripts_keep_their_text():
    assert html.parse("<script>a && b &amp;</script>").find("script").children == ["a && b &amp;"]


def test_links_parse_each_page_once(spark, sf):
    from corpusloom.plans import catalogue

    plan = catalogue.QUERIES["html_links"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_pages_beyond_one_slice(spark):
    n = 2 * html.AT_ONCE + 1
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", f"<title>t{i}</title>") for i in range(n)], "i int, url string, html string").coalesce(1)
    assert [(r["i"], r["title"]) for r in html.parse_pages(pages).orderBy("i").collect()] == [(i, f"t{i}") for i in range(n)]
