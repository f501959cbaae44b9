"""Words and windows of odd texts, against Python's own split."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking
from corpusloom.plans import catalogue

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


def texts():
    rng = random.Random(5)
    chars = SPACES + "a\x00~\x7f\x84\xa1ᙿ​‐\U0001f600" * 4
    made = ["".join(rng.choices(chars, k=rng.randrange(60))) for _ in range(300)]
    return ["", " ", "　\n", "one", " one ", *made, " ".join(map(str, range(349))), "\n".join(map(str, range(350))), " " + "\xa0".join(map(str, range(1051))) + " "]


def test_words_of_odd_texts(spark):
    rows = spark.createDataFrame([*enumerate(texts()), (-1, None)], "i int, t string").repartition(4)
    t = F.col("t")
    got = {r["i"]: r for r in rows.select("i", tx.word_count(t).alias("n"), tx.strip(t).alias("s"), tx.truncate_words(t, 4).alias("c"), tx.trim_to_words(t, 3).alias("f"), tx.trim_to_words(t, F.lit(3)).alias("g"), chunking.word_windows("t").alias("w")).collect()}
    assert [got[-1][c] for c in "scfgw"] == [None] * 5
    for i, x in enumerate(texts()):
        w = x.split()
        assert (got[i]["n"], got[i]["s"], got[i]["c"]) == (len(w), x.strip(), x.strip() if len(w) <= 4 else " ".join(w[:4])), repr(x)
        assert got[i]["f"] == got[i]["g"] == " ".join(w[:3]) and got[i]["w"] == [" ".join(w[k : k + 350]) for k in range(0, len(w), 350)], repr(x)


def test_a_text_is_cut_into_windows_once(spark, sf):
    plan = catalogue.QUERIES["chunk_words"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
