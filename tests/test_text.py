import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.functions import text as tx
from corpusloom.functions.vectors import cosine, unit


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_mojibake(spark):
    words = ["plain", "café", "Gödel’s", "naïve", "日本"]
    once = [w.encode().decode("latin-1") for w in words]
    twice = [w.encode().decode("latin-1") for w in once]
    assert column(spark, tx.fix_mojibake, once) == words
    assert column(spark, tx.fix_mojibake, twice) == words
    kept = ["Ã", "a\x85b", "Ã© and 日", "", None]
    assert column(spark, tx.fix_mojibake, kept) == kept


def test_white_space(spark):
    texts = [" a \xa0 b\t\tc ", "a\n\n\n\nb", " x ", "", None]
    assert column(spark, tx.normalize_whitespace, texts) == ["a b c", "a\n\nb", "x", "", None]
    assert column(spark, tx.word_count, ["a b c", "", " "]) == [3, 0, 0]
    assert column(spark, lambda c: tx.truncate_words(c, 2), [" a  b ", "a\nb c"]) == ["a  b", "a b"]
    assert column(spark, lambda c: tx.trim_to_words(c, 2), ["a\nb c", "a\nb"]) == ["a b", "a b"]
    assert column(spark, lambda c: tx.trailing_words(c, 2), ["a b c", "a", ""]) == ["b c", "a", ""]


def plain_title_bonus(query, title):
    import re

    def tokens(s):
        return re.sub("[^a-z0-9]+", " ", re.sub(r"'s(?!\w)", "", s.lower().replace("’", "'"))).split()

    q = [t for t in tokens(query) if t not in K.STOPWORDS]
    t = tokens(title)
    while t and t[0] in ("a", "an", "the"):
        t.pop(0)
    if not q or not t:
        return 0.0
    qs, ts = " ".join(q), " ".join(t)
    phrase = 2.5 if qs == ts else (1.5 if len(t) > 1 else 1.0) if ts in qs else 0.0
    return phrase + 0.8 * len(set(q) & set(t)) / len(set(t)) + (0.6 if len(set(t)) > 1 and set(t) <= set(q) else 0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.sampled_from("the a of art heart Truth truth’s logic in mind free speech".split()), max_size=5)] * 2), min_size=40, max_size=40))
def test_title_bonus(spark, pairs):
    pairs = [(i, " ".join(q), " ".join(t)) for i, (q, t) in enumerate(pairs)]
    rows = spark.createDataFrame(pairs, "i int, q string, t string").select("i", tx.title_bonus(F.col("q"), F.col("t")).alias("b"))
    found = {r["i"]: r["b"] for r in rows.collect()}
    for i, q, t in pairs:
        assert found[i] == pytest.approx(plain_title_bonus(q, t)), (q, t)


def test_lexical_traps(spark):
    one = lambda f, a, b: spark.range(1).select(f(F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert one(tx.title_bonus, "freedom of speech", "Freedom of Speech") < 2.5  # the title keeps its stop word
    assert one(tx.title_bonus, "heart", "art") == pytest.approx(1.0)  # containment isn't by token
    assert one(tx.section_bonus, "the free will", "the will") == pytest.approx(0.4)
    assert one(tx.section_bonus, "", "will") == 0


def test_snippet_ids_labels(spark):
    assert column(spark, lambda c: tx.snippet(c, 10), ["aaaa bbbbb cc", "aa bbbbbbbbbbb", "abcdefghijklm", "short"]) == ["aaaa bbbbb...", "aa bbbbbbb...", "abcdefghij...", "short"]
    assert column(spark, tx.uuid5, ["truth", "café"]) == [str(uuid.uuid5(uuid.UUID(K.ENTRY_NAMESPACE), x)) for x in ("truth", "café")]
    assert column(spark, lambda c: tx.label_of(c, K.ALIASES), [" Mind,  Philosophy of;", "ETHICS.", "x"]) == ["Philosophy of Mind", "Ethics", None]


def test_urls(spark):
    urls = ["https://h.org/entries/truth/?x=1#2", "http://h.org/entries/truth", "http://h.org/other/truth", "http://h.org/entries/a/b", None]
    assert column(spark, tx.entry_url, urls) == ["https://h.org/entries/truth/", "http://h.org/entries/truth/", None, None, None]
    assert column(spark, lambda c: tx.url_parameter(c, "id"), ["http://h/e?id=kant&x=1", "http://h/e?id=", "http://h/e", "not a url %%"]) == ["kant", None, None, None]
    heads = column(spark, tx.heading_parts, ["2.3. On  Truth", "Truth", "1 A"])
    assert [tuple(h) for h in heads] == [("2.3", "On Truth"), ("", "Truth"), ("1", "A")]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    found = rows.select(cosine(F.col("a"), F.col("b")).alias("c"), unit(F.col("a")).alias("u")).collect()
    assert [r["c"] for r in found] == [1.0, 0.0, None]
    assert found[0]["u"] == pytest.approx([0.6, 0.8]) and found[2]["u"] == [0, 0]
