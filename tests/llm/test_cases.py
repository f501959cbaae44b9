"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm.common import written
from corpusloom.llm.near_dups import meetings as near_meetings
from corpusloom.llm import ann, chat_format, decontam, licences, near_dups, near_vectors, pieces, pii, prefix_trie, quality, suffix_dedup, url_filter, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, _k1 string, score string, pii string, spots string"
LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(20_000))
STORY = " ".join(f"tale{i}" for i in range(60))


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "a", "b", "c", "d", "e") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, LONG), (4, STORY), (4, STORY), (5, STORY), (None, STORY), (6, "!!! ???"), (7, STORY.replace("tale7 ", "other ")), (8, "one two"), (9, "mail me@x.org")]
    return documents(spark, *rows).persist()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark)


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame([(1, STORY[:200]), (2, "One  TWO"), (3, None), (None, STORY), (4, ""), (5, "absent words")], "item_id long, text string")
    found = decontam.find_items(odd, items)
    rows = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect()}
    assert found.count() == odd.count() and (8, 2, 2, ("2",)) in rows and (1, 0, 0, ()) in rows and (3, 40_000, 0, ()) in rows
    assert all(r[2] > 9 and r[3] == ("1",) for r in rows if r[0] in (4, 5, None))
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 6, 9]
    assert decontam.find_items(none, items).count() == 0
    assert decontam.find_items(odd, items.limit(0)).filter("n_hit > 0").count() == 0


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (3, 4, 5, 8, 9)] + [(None, 1, 0), (6, None, 0), (7, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] == STORY}) == 1
    assert quality.score(none, model).count() == 0
    blank = quality.train(none, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, blank).collect()} == {0.5}


def test_quality_learns_and_calibrates():
    good, bad = ["calm words of the day"] * 30, ["LOUD!! WORDS!! NOW!!"] * 10
    model = quality.fit(quality.features(good + bad), np.array([1] * 30 + [0] * 10))
    s = model.scores(["calm day", "LOUD!! DAY!!", ""])
    assert s[0] > 0.7 > s[1] and 0 <= s[2] <= 1


def test_pieces(odd, none):
    rows = pieces.decode_pieces(pieces.encode_texts(odd)).collect()
    assert all(r["decoded"] == r["text"] for r in rows) and any(r["pieces"] is None for r in rows)
    assert len({tuple(r["pieces"]) for r in rows if r["text"] == STORY}) == 1
    assert pieces.encode_texts(none).count() == 0


def test_each_occurrence_is_drawn_on_its_own():
    text, v = " wonderful" * 4000, pieces.vocabulary(pieces.MODEL)
    (ids,) = pieces.Encoder(dropout=0.1).encode([text])
    cuts, unit, at = [], [], 0
    for i in ids.tolist():
        unit.append(i)
        at += len(v.texts[i])
        if at % 10 == 1 and at > 1:  # the model's own space comes first
            cuts.append(tuple(unit))
            unit = []
    assert len(set(cuts)) > 4
    encoder = pieces.Encoder(dropout=0.1)
    units = pieces._UNITS.findall(" " + text)
    one_by_one = [i for u, k in zip(units, encoder._occurrences(text, len(units)).tolist(), strict=True) for i in pieces.encode_unit(v, u, k, 0.1, pieces.SEED)]
    assert ids.tolist() == one_by_one


def test_licences(spark, none):
    mit = next(t for n, t in licences.KNOWN if n == "MIT").split("[fullname]")[1]
    rows = [(1, "Copyright (c) 2020 Me\n\n" + mit.upper().replace(".", " ;")), (2, "x\nreleased under the MIT licence\nLicensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, LONG), (5, LONG), (6, "...")]
    known = licences.known_licences(spark)
    found = [(r["doc_id"], r["license"], r["notices"]) for r in licences.scan(documents(spark, *rows), known).collect()]
    assert sorted(found, key=lambda r: r[0]) == [(1, "MIT", []), (2, None, ["CC-BY-NC-4.0", "MIT"]), (3, None, []), (4, None, []), (5, None, []), (5, None, []), (6, None, [])]
    assert licences.scan(none, known).count() == 0 and licences.scan(documents(spark, *rows), known.limit(0)).filter("license is not null").count() == 0


def test_whole_licences(spark):
    texts = {p.stem: p.read_text() for p in (Path(licences.__file__).parent / "licence_texts").glob("*.txt")}
    wrapped = {n: re.sub(r"(?<=[a-z,;]) *\n *(?=[A-Za-z])", " ", t) for n, t in texts.items()}
    cased = {n: t.upper() for n, t in texts.items()}
    rows = [(i, t) for i, t in enumerate(t for kind in (texts, cased, wrapped) for t in kind.values())]
    names = [n for _ in range(3) for n in texts]
    mit = "The MIT License (MIT)\r\n\r\nCopyright © 2019-2021 Some One <a@b.org>\r\nCopyright (C) 2022, Others\r\n" + texts["MIT"].split("[fullname]")[1].replace("\n", "\r\n").replace("OR\r\nIMPLIED", "OR IMPLIED").replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\r\nCOPYRIGHT")
    bsd = "(c) 2001 The Firm. All rights reserved.\n" + texts["BSD-2-Clause"].split("[fullname]")[1].replace("1. ", "- ").replace("2. ", "- ")
    rows += [(len(rows), mit), (len(rows) + 1, bsd), (len(rows) + 2, texts["MIT"] + "\nNot for any use at all.")]
    found = {r["doc_id"]: (r["license"], r["digest"]) for r in licences.scan(documents(spark, *rows), licences.known_licences(spark)).collect()}
    assert [found[i][0] for i in range(len(rows))] == [*names, "MIT", "BSD-2-Clause", None]
    assert all(found[i][1] == hashlib.sha256(licences.canonical(t).encode()).hexdigest() for i, t in rows)


def test_pii(odd, none):
    rows = pii.find_pii(odd).withColumn("red", pii.redact("text", "pii")).collect()
    assert {r["doc_id"]: r["red"] for r in rows}[9] == "mail <email>" and {r["doc_id"]: r["red"] for r in rows}[1] is None
    assert pii.find_pii(none).count() == 0
    digits = "1" * 100_000 + "@" * 1000 + "+1 " * 1000
    assert [s for s in pii.spans(digits) if s[0] != "phone"] == []


def test_cues_in_any_case():
    text = 'ACCT 12345678, Token = "04dbebab91ab85687d33eeaa", PASSWORD: hunter22 Tel. (743) 555-3824, Ünïcode iban gb82 west 1234 5698 7654 32, token: individual'
    found = {(k, text[s:e]) for k, s, e in pii.spans(text)}
    assert found >= {("account", "12345678"), ("secret", "04dbebab91ab85687d33eeaa"), ("secret", "hunter22"), ("tel", "(743) 555-3824"), ("iban", "gb82 west 1234 5698 7654 32")}
    assert not [x for k, x in found if x.startswith("indiv")]


def test_long_login():
    secret = "me:" + "ey!" * 2000
    assert ("login", 8, 8 + len(secret)) in pii.spans(f"https://{secret}@localhost/x")
    assert len(pii.spans("token=" * 100_000 + "1")) == 1
    many = "http://a:b" * 100_000
    assert not [s for s in pii.spans(many) if s[0] == "login"]


def test_urls(spark):
    urls = ["http://a.com/x", "http://COM/x", "http://a.com", "http://example.com/en/1", "http://m.example.com/en/1", "http://www.example.com/en/", "ftp://x.net/es/?q", "http://a.net/fr/", "http://a.net/de/1/?utm_source=x&b=1#f", "https://www.a.net/de/1?b=1", "nonsense", None]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = url_filter.mirrored_urls(pages)
    rows = [(r["host"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed).orderBy("page_id").collect()]
    assert rows == [("a.com", "com/", "allow"), ("com", "com/", "allow"), ("a.com", None, "allow"), ("example.com", "example.com/en/", "block"), ("m.example.com", "example.com/en/", "block"), ("www.example.com", "www.example.com/en/", "allow"), ("x.net", "net/es/", "block"), ("a.net", "net/fr/", "block"), ("a.net", None, "block"), ("www.a.net", None, "block"), ("", None, "allow"), ("", None, "allow")]
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0)).filter("listed").count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    pages = spark.range(9000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"))
    found = url_filter.filter_urls(pages, keys)
    assert found.filter("verdict = 'block'").count() == 3000
    blocks, n = url_filter.bloom_blocks(keys)
    assert blocks.count() <= n and n == -(-3000 * url_filter.BITS_PER_KEY // url_filter.BLOCK_BITS)


def test_chats(spark):
    odd = "a<|done|>&lt;[INST]</s>&amp;<|also|>"
    rows = [(1, 0, "user", odd), (1, 1, "user", None), (1, 1, "user", None), (1, None, None, "first"), (1, 2, "assistant", odd), (1, 3, "assistant", ""), (None, 0, "assistant", "x"), (2, 0, "<|turn|>", "y")]
    chats = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    back = {r["conv_id"]: r for r in chat_format.read_chats(chat_format.format_chats(chats)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("", "first"), ("user", odd), ("user", ""), ("user", ""), ("assistant", odd), ("assistant", "")]
    assert back[1]["loss_text"] == odd and back[None]["loss_text"] == "x" and [tuple(t) for t in back[2]["turns"]] == [("<|turn|>", "y")]
    assert back[1]["formatted"].count("<|turn|>") == 3
    assert chat_format.read_chats(chat_format.format_chats(chats.limit(0))).count() == 0


def test_repeats(spark, none):
    base = "".join(chr(97 + (i * i) % 23) for i in range(500)) * 2
    rows = [(1, None), (2, ""), (3, "a" * 3000), (4, base[:700]), (5, "é" + base[50:650]), (5, "é" + base[50:650]), (6, base[:399]), (7, LONG)]
    from test_queries import brute_repeats

    found = suffix_dedup.remove_repeats(documents(spark, *rows)).select("doc_id", "n_bytes", "kept", "spans").collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found)
    assert got == sorted((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 400), strict=True))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_interleave_is_the_merged_order():
    r = np.random.default_rng(1)
    runs = []
    for n in (40, 1, 25):
        e = np.zeros(n, suffix_dedup._ENTRY)
        for name in ("tail", "s2", "s1"):
            e[name] = r.integers(0, 3, n)
        e["many"] = 1
        runs.append(e[np.lexsort((e["s1"], e["s2"], e["tail"]))])
    z, block = suffix_dedup.interleaved(runs)
    every = np.concatenate(runs)
    keys = [tuple(every[i][["s1", "s2", "tail"]]) for i in z]
    assert keys == sorted(keys) and len(set(keys)) == len(set(block.tolist()))
    assert all(keys.count(k) > 1 for k in keys)
    assert sorted(z.tolist()) == [i for i, e in enumerate(every) if sum(e[["s1", "s2", "tail"]].tolist() == x for x in every[["s1", "s2", "tail"]].tolist()) > 1]


@pytest.mark.parametrize("bucket", [1 << 12, 1 << 24])
def test_repeats_in_many_buckets(spark, bucket):
    r = np.random.default_rng(4)
    word = [f"w{i}" for i in range(5000)]
    passage = " ".join(r.choice(word, 120))
    texts = [" ".join(r.choice(word, r.integers(1, 300))) for _ in range(60)]
    texts += [f"{' '.join(r.choice(word, 60))} {passage[: r.integers(300, 700)]} {' '.join(r.choice(word, 60))}" for _ in range(80)]
    found, _ = suffix_dedup.repeats(documents(spark, *enumerate(texts)), bucket=bucket)
    runs = {}
    for x in found.filter("first >= 0").collect():
        runs.setdefault((x["k1"], x["k2"]), []).append((x["first"], x["last"]))
    keys = {x["doc_id"]: (x["k1"], x["k2"]) for x in documents(spark, *enumerate(texts)).select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")).collect()}
    from test_queries import brute_repeats

    for i, (n, gone, spans, _) in enumerate(brute_repeats(texts, 400)):
        kept, cuts = suffix_dedup.cut(texts[i].encode(), runs.get(keys[i], []), 400)
        assert (n - len(kept), len(cuts)) == (gone, spans)


def test_passages_of_other_texts_are_told(spark):
    r = np.random.default_rng(5)
    word = [f"w{i}" for i in range(3000)]
    passage = " ".join(r.choice(word, 52))
    assert len(passage) < 400
    texts = [" ".join(r.choice(word, 200)) for _ in range(6)]
    texts += [f"{' '.join(r.choice(word, 40))} {passage} {' '.join(r.choice(word, 40))}" for _ in range(3)]
    rows = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(documents(spark, *enumerate(texts))).collect()}
    assert [i for i in rows if rows[i]["shared"]] == [6, 7, 8] and all(not x["spans"] for x in rows.values())


def test_near_duplicates(spark, odd, none):
    classes = near_dups.near_classes(odd)
    rows = {(r["doc_id"], r["class_id"], r["class_size"]) for r in classes.collect()}
    assert classes.count() == odd.count()
    assert {r[1] for r in rows if r[0] in (4, 5, 7, None)} == {4} and {r[2] for r in rows if r[0] == 4} == {5}
    assert {(1, 1, 2), (2, 1, 2), (3, 3, 1), (6, 6, 1), (8, 8, 1)} <= rows
    kept = near_dups.one_of_each(odd, classes)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6, 8, 9]
    assert near_dups.near_classes(none).count() == 0


def test_near_duplicates_in_a_crowded_bucket(spark):
    passage = " ".join(f"common{i}" for i in range(170))
    texts = [f"{passage} {' '.join(f'pair{p}x{i}' for i in range(16))} {' '.join(f'own{p}y{k}y{i}' for i in range(14))}" for p in range(200) for k in range(2)]
    found = {r["doc_id"]: r["class_id"] for r in near_dups.near_classes(documents(spark, *enumerate(texts))).collect()}
    frequency = near_dups.frequencies(documents(spark, *enumerate(texts)))
    twins = near_dups.similarity(texts[::2], texts[1::2], frequency)
    assert near_dups.similarity(texts[1:-1:2], texts[2::2], frequency).max() < near_dups.SIMILAR <= twins.min()
    assert found == {i: i - i % 2 for i in range(len(texts))}


def test_linked_finds_what_single_comparisons_find():
    r = np.random.default_rng(3)
    texts = []
    for _ in range(60):
        words = [f"w{k}" for k in r.integers(0, 300, r.integers(20, 120))] + ["again and"] * int(r.integers(0, 20))
        cut = [*words]
        for k in r.integers(0, len(words), r.integers(0, 4)):
            cut[k] = "other"
        texts += [" ".join(words), " ".join(cut[: len(cut) - r.integers(0, 10)])]
    frequency = near_dups.Frequencies(r.integers(1, 9, (2, 1 << 10)), 9)
    weights, items = zip(*near_dups.packed(texts, frequency), strict=True)
    one_by_one = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if near_dups.similar(items[i], weights[i], items[j], weights[j], frequency) >= 0.8}
    assert set(near_dups.linked(items, np.array(weights), np.arange(len(texts)), frequency, 0.8)) == one_by_one and len(one_by_one) > 10
    halves = np.arange(len(texts)) // 60
    assert len(near_dups.linked(items, np.array(weights), halves, frequency, 0.8)) == any(i < 60 <= j for i, j in one_by_one)


def test_sampling_estimates_weighted_jaccard():
    texts = [" ".join(f"w{i}" for i in range(a, a + 400)) for a in (0, 40)]
    frequency = near_dups.Frequencies(np.ones((2, 1 << 10), np.int64), 2)
    sampler = near_dups.Sampler(900)
    (_, many, owner, shingle, count), *rest = near_dups.shingles(texts)
    a, b = sampler.keys(many, owner, shingle, count * frequency.weight(shingle), bands=900)
    true = near_dups.similarity(texts[:1], texts[1:], frequency)[0]
    assert not rest and abs((a == b).mean() - true) < 0.06


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0, 0.0]), (1, None), (2, [0.0] * 4), (3, [nan, 1.0, 0.0, 0.0]), (4, [inf, 1.0, 0.0, 0.0]), (5, [None, 1.0, 0.0, 0.0]), (6, [1.0]), (None, [1.0] * 4), (9, [0.0, 1.0, 0.0, 0.0]), (8, [0.0, 1.0, 0.0, 0.0]), (7, [2.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, vector int")
    vectors, dim = ann.valid_vectors(table)
    assert dim == 4 and sorted(r["vec_id"] for r in vectors.collect()) == [0, 7, 8, 9]
    found = ann.search(vectors.filter("vec_id = 0"), ann.Index(vectors, dim)).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in found] == [(1, 7), (2, 8), (3, 9)]
    assert ann.valid_vectors(table.limit(0))[1] == 0


def test_walk_is_in_order():
    near = np.array([0.5, 0.1, 0.9]), np.array([0.3, 0.2])
    counts = np.arange(1, 7)
    cells = ann.walk(near, counts, 10**6)
    cost = [near[0][c // 2] + near[1][c % 2] for c in cells]
    assert cost == sorted(cost) and sorted(cells) == list(range(6))
    assert ann.walk(near, counts, 1) == [cells[0]]


def test_pipeline_stages(spark, tmp_path):
    import os

    source = "/root/testdata/sf0.001"
    for name in os.listdir(source):
        os.symlink(f"{source}/{name}", tmp_path / name)
    docs = spark.read.parquet(f"{source}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        seen[name] = spark.read.parquet(f"{tmp_path}/out-{name}")
        if name != "pieces":
            assert out.columns == docs.columns
            docs = seen[name]
    ids = {n: [r["doc_id"] for r in df.select("doc_id").collect()] for n, df in seen.items()}
    assert set(ids["near_dups"]) < set(ids["quality"]) and set(ids["decontaminate"]) < set(ids["near_dups"])
    assert sorted(ids["pii"]) == sorted(ids["decontaminate"]) == sorted(ids["pieces"])
    from test_queries import WORD, plain_pii, shingles

    # By brute force: each class of the stage's input has one row left, and what holds a window of an item goes.
    before = seen["quality"].select("doc_id", "text")
    classes = {r["doc_id"]: r["class_id"] for r in near_dups.near_classes(before).collect()}
    assert sorted(ids["near_dups"]) == sorted(set(classes.values()))
    model = quality.train(spark.read.parquet(f"{source}/documents.parquet"), spark.read.parquet(f"{source}/labels.parquet"))
    scores = dict(zip(*zip(*[(r["doc_id"], s) for r, s in ((r, model.scores([r["text"]])[0]) for r in spark.read.parquet(f"{source}/documents.parquet").collect())], strict=True), strict=True))
    assert sorted(ids["quality"]) == sorted(i for i, s in scores.items() if s >= quality.GOOD)
    split = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [split(r["text"]) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(len(w) - 9, 1))}
    held = {r["doc_id"] for r in seen["near_dups"].collect() if any(tuple(w[i : i + n]) in windows for w in [split(r["text"])] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))}
    assert held and set(ids["decontaminate"]) == set(ids["near_dups"]) - held

    kept = [shingles(r["text"]) for r in seen["near_dups"].collect()]
    assert all(len(a & b) < 0.86 * len(a | b) for i, a in enumerate(kept) for b in kept[:i] if a & b)
    assert all(not [s for s in plain_pii(r["text"]) if s.startswith(("email", "card", "phone"))] for r in seen["pii"].collect())
    assert seen["pieces"].filter("not lossless").count() == 0
    texts = {r["doc_id"]: r["text"] for r in seen["pii"].collect()}
    v = pieces.vocabulary(pieces.MODEL)
    assert all(pieces.decode_ids(v, r["pieces"]) == texts[r["doc_id"]] for r in seen["pieces"].collect())


def test_pipeline_of_nothing(spark, odd, none):
    sf = "/root/testdata/sf0.001"
    for rows in (none, odd):
        for name, stage in corpus_pipeline.STAGES[1:4]:
            out = stage(spark, rows, sf)
            assert out.columns == rows.columns, name
            assert out.count() <= rows.count()
    assert corpus_pipeline.quality_stage(spark, none, sf).count() == 0 and corpus_pipeline.pieces_stage(spark, none, sf).count() == 0


def test_odd_rows_through_the_whole_pipeline(spark, odd):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000).unionByName(odd, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "pieces":
            assert out.count() == docs.count() and out.filter("not lossless").count() == 0
        else:
            assert out.columns == docs.columns and out.count() <= docs.count(), name
            docs = written(out, f"odd-{name}")
    learned = quality.train(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, learned).collect())


def brute_trie(turns):
    """turns: conv_id -> its turns in order. Nodes by (least member, depth), from sets of members."""
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - math.fmod(c, 100), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in sorted(built.items()):
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = set()
    for seq, cs in members.items():
        inside = [x for x in members if x[: len(seq)] == seq]
        kids = sum(len(x) == len(seq) + 1 for x in inside)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in inside) for x in inside)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in inside if x)
        ends = ",".join(str(c) for c in cs if built[c] == seq)
        out.add((cs[0], len(seq), members[seq[:-1]][0] if seq else None, len(cs), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


CHATS = "conv_id long, turn long, role string, text string, key string, path string, level int, cut int, n int"


@pytest.mark.parametrize("together, shard", [(128, 256), (1, 1), (3, 4)])
def test_prefix_trie(spark, together, shard):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"say {c % 3 if c % 7 else c} {t if t < 4 else c % 2}") for c in range(95, 330) for t in range(c % 9)]
    rows += [(c, t, "user", "the same") for c in range(400, 460) for t in range(7)] + [(500, t, "user", str(t % 5)) for t in range(300)]
    rows += [(-205, None, None, None), (-205, 1, "user", "é😀"), (-205, 1, "user", "é😀"), (-205, 1, "", "z"), (-200, 0, "user", None), (None, 0, "user", "lost"), (7, 0, "user", ""), (8, None, "b", "x"), (8, None, "a", "y")]
    turns = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns[c].append((role or "", text or ""))
    df = spark.createDataFrame([(*r, "k", "p", 1, 2, 3) for r in rows], CHATS).repartition(5)
    assert {tuple(r) for r in prefix_trie.trie_nodes(df, together, shard).collect()} == brute_trie(turns)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.trie_nodes(spark.createDataFrame([], CHATS)).count() == 0


def test_double_array():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 40, rng.integers(0, 9)) for _ in range(500)]
    sizes = np.array([len(s) for s in seqs])
    trie = prefix_trie.packed(np.concatenate(seqs), np.cumsum(sizes) - sizes, sizes, 40)

    def find(seq):
        at = np.zeros(1, np.int64)
        for code in seq:
            at = trie.step(at, np.array([code]))
            if at[0] < 0:
                return None
        return int(at[0])

    there = {tuple(s[:d]) for s in seqs for d in range(len(s) + 1)}
    assert len({find(s) for s in there}) == len(there) and None not in {find(s) for s in there}
    assert (trie.check >= 0).sum() == len(there) and all(find((*s, 39 - s[0])) is None for s in there if s and (*s, 39 - s[0]) not in there)


VECTORS = "vec_id long, embedding array<double>, label int, component int, whitened string, f int, n int, links int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "w", 3, 4, 5) for i, v in rows], VECTORS)


def whitened_by_brute_force(rows, k=32):
    ids, x = [i for i, _ in rows], np.floor(64 * np.array([v for _, v in rows])).astype(int)
    n, sums = len(ids), x.sum(0)
    y = x - sums / n
    w, e = np.linalg.eigh(y.T @ y / n)
    w, e = w[::-1][:k], e[:, ::-1][:, :k]
    return ids, ((n * x - sums) ** 2).sum(1), y @ e / np.sqrt(w), w / np.trace(y.T @ y / n), w


def check_whitening(found, rows):
    ids, deviation, whitened, explained, w = whitened_by_brute_force(rows)
    k = len(explained)
    assert len(found) == len(rows) * k
    got = defaultdict(list)
    for r in found:
        got[r["component"]].append((r["vec_id"], r["deviation"], r["whitened"], r["explained"], r["n"], r["identity_error"]))
    assert sorted(got) == list(range(1, k + 1))
    for c, have in got.items():
        assert sorted((i, d) for i, d, *_ in have) == sorted(zip(ids, deviation.tolist(), strict=True))
        assert all(n == len(rows) and e == pytest.approx(explained[c - 1], rel=1e-9) and err < 1e-9 for _, _, _, e, n, err in have)
        alone = min([abs(w[c - 1] - w[j]) for j in range(len(w)) if j != c - 1], default=1) > 1e-4 * w[0]
        if alone and c < k:
            have, want = sorted((i, x) for i, _, x, *_ in have), sorted(zip(ids, whitened[:, c - 1].tolist(), strict=True))
            sign = np.sign(np.dot([x for _, x in have], [x for _, x in want])) if len(set(ids)) == len(ids) else 0
            assert not sign or np.allclose([x for _, x in have], sign * np.array([x for _, x in want]), atol=1e-8)


def test_whitening_is_the_brute_force_one(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.standard_normal((700, 40)) * np.linspace(3, 0.3, 40))]
    rows += [(700 + i, [0.5] * 40) for i in range(300)] + [(1000, [0.0] * 40)]
    whole, d = whitening.whole_vectors(vectors(spark, rows).repartition(7))
    check_whitening(whitening.Whitening(whole, d).rows().collect(), rows)


def test_whitening_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(whitening.query(spark, sf).collect(), rows)


def test_whitening_of_odd_rows(spark):
    good = [(1, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [0.0, 0.0, 0.0]), (4, [0.5, -3.0, 2.0]), (5, [9.25, 1.0, 2.0])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0]), (9, [float("inf"), 1.0, 1.0]), (10, [1.0, 2.0]), (11, []), (12, [1e300, 0.0, 0.0])]
    rows = lambda x: whitening.Whitening(*whitening.whole_vectors(vectors(spark, x))).rows().collect()
    found = rows([*good, *bad])
    ids, deviation, _, explained, _ = whitened_by_brute_force(good)
    assert sorted((r["vec_id"], r["deviation"]) for r in found if r["component"] == 1) == sorted(zip(ids, deviation.tolist(), strict=True))
    assert {round(r["explained"], 9) for r in found} == {round(float(e), 9) for e in explained if e > 1e-9} and all(r["identity_error"] < 1e-9 for r in found)
    assert any(r["vec_id"] is None for r in rows([*good, (None, [3.0, 3.0, 3.0])]))
    assert rows(good[:1]) == [] and rows([good[0]] * 3) == [] and rows([]) == [] and rows(bad) == []
    wide = [(i, [float(i) * 2**40, 1.0 - i]) for i in range(4)]
    assert all(r["deviation"] is None for r in rows(wide))


def test_eigenpairs_are_converged():
    rng = np.random.default_rng(2)
    for d, k in ((60, 32), (200, 7), (3, 32)):
        a = rng.standard_normal((d, 3 * d)) * np.linspace(1, 9, d)[:, None]
        v = a @ a.T / d
        values, axes = whitening.jacobi_davidson(lambda b, v=v: v @ b, d, k)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], rtol=1e-12)
        assert np.linalg.norm(v @ axes - axes * values, axis=0).max() < 1e-12 * values[0] and np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)


def brute_links(rows, threshold=0.95):
    """vec_id -> (n_links, component_id, kept) from all pairs."""
    best = {}
    for i, v in rows:
        if i is not None:
            ok = v is not None and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v) and any(v)
            best[i] = min([b for b in (best.get(i), list(v) if ok else None) if b is not None], default=None)
    ids = sorted(i for i in best if best[i] is not None)
    x = np.array([best[i] for i in ids], float)
    u = x / np.abs(x).max(axis=1)[:, None]
    u /= np.linalg.norm(u, axis=1)[:, None]
    alike = u @ u.T >= threshold
    root = near_vectors._roots(len(ids), *np.nonzero(alike))
    out = {i: (int(alike[k].sum()) - 1, ids[root[k]], ids[root[k]] == i) for k, i in enumerate(ids)}
    return {i: out.get(i, (0, i, True)) for i in best}


@pytest.mark.parametrize("sizes", [{}, {"sample": 300, "leaf": 20, "block": 16}])
def test_near_vectors_are_those_of_all_pairs(spark, sizes):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((900, 8))
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = base[:300] + rng.standard_normal((300, 8)) * 0.1
    crowd = base[5] + rng.standard_normal((150, 8)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, crowd, crowd[:40], crowd[:40] * 3]))]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] * 4), (2003, [float("nan")] * 8), (2004, [float("inf")] + [1.0] * 7), (2005, [1.0]), (2006, []), (None, rows[0][1]), (7, rows[8][1]), (2000, rows[3][1]), (2007, [1e300] * 8), (2008, [1e-300] * 8)]
    df = vectors(spark, rows).repartition(6)
    found = near_vectors.near_vectors(df, **sizes)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = {r[0]: tuple(r)[1:] for r in found.collect()}, brute_links(rows)
    assert got[2007][0] == got[2008][0] > 0 and got == want and found.count() == len(want)


def test_near_vectors_of_nothing(spark):
    assert near_vectors.near_vectors(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in near_vectors.near_vectors(vectors(spark, [(3, None), (3, [0.0]), (None, [1.0])])).collect()] == [(3, 0, 3, True)]
    assert [tuple(r) for r in near_vectors.near_vectors(vectors(spark, [(3, [1.0, 2.0])])).collect()] == [(3, 0, 3, True)]


def test_forest_keeps_near_vectors_together():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((2000, 64))
    side -= (side * x[:2000]).sum(1)[:, None] * x[:2000]
    side /= np.linalg.norm(side, axis=1)[:, None]
    other = 0.951 * x[:2000] + np.sqrt(1 - 0.951**2) * side
    forest = near_vectors.Forest(x, len(x), 64)
    of = [defaultdict(set), defaultdict(set)]
    for k, v in enumerate((x[:2000], other)):
        for r, leaf in zip(*(a.tolist() for a in forest.leaves(v)), strict=True):
            of[k][r].add(leaf)
    assert all(of[0][r] & of[1][r] for r in range(2000))
    rows, leaves = forest.leaves(x)
    assert len(rows) < 5 * 8 * len(x) and np.bincount(leaves).max() < 1200


def test_many_windows_meet_the_corpus_without_its_words(spark, sf, odd, none, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda rows: sorted(((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["items"], sorted(map(tuple, r["hits"]))) for r in rows), key=str)
    want = key(decontam.find_items(docs, items).collect())
    strange = spark.createDataFrame([(1, STORY[:200]), (2, "One  TWO"), (3, None), (None, STORY), (4, ""), (5, "absent words")], "item_id long, text string")
    usual = key(decontam.find_items(odd, strange).collect())
    monkeypatch.setattr(decontam, "BROADCAST", 0)
    made = []
    monkeypatch.setattr(decontam, "written", lambda df, name: made.append(df) or written(df, name))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        hits = key(decontam.find_items(docs, items).collect())
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in made]
        assert key(decontam.find_items(odd, strange).collect()) == usual and decontam.find_items(none, strange).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert hits == want and any(r[2] for r in hits)
    assert not any("BroadcastHashJoin" in p for p in plans)
    assert not re.search(r"Exchange.*\n(.*\n)?.*Project \[[^\]]*dws[^\]]*shingle", "\n".join(plans))


def test_a_crowd_of_one_root_meets_only_the_texts_beside_it(spark):
    row = lambda i, r, key=1: (1, key, (i, i), (r, r))
    rows = [row(i, 0) for i in range(900)] + [row(1000 + i, 1000 + i // 2) for i in range(20)] + [row(2000 + i, 2000) for i in range(50)] + [row(i, 0, 2) for i in range(300)]
    placed = spark.createDataFrame(rows, "band int, key long, t struct<k1: long, k2: long>, root struct<k1: long, k2: long>")
    met = near_dups.meetings(placed, 16).collect()
    assert {r["key"] for r in met} == {1}
    groups = defaultdict(list)
    for r in met:
        groups[r["low"], r["high"]].append((r["t"][0], r["root"][0]))
    pairs = {frozenset((a, b)) for g in groups.values() for a, x in g for b, y in g if x != y}
    of = {t[0]: r[0] for _, k, t, r in rows if k == 1}
    assert pairs == {frozenset((a, b)) for a in of for b in of if of[a] < of[b]}
    assert len(met) < 15 * len(of)


def test_near_copies_and_an_outlier(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    copies = [" ".join([*words[: i % 120], f"x{i}", *words[i % 120 + 1 :]]) for i in range(600)]
    outlier = " ".join([*words[:60], *[f"y{i}" for i in range(60)]])
    sizes = []
    monkeypatch.setattr(near_dups, "meetings", lambda placed, block=near_dups.BLOCK: (sizes.append(placed.count()), near_meetings(placed, 64))[1])
    found = {r["doc_id"]: r["class_id"] for r in near_dups.near_classes(documents(spark, *enumerate([*copies, outlier]))).collect()}
    assert {found[i] for i in range(600)} == {0} and found[600] == 600


def test_urls_that_clash_repeat_and_are_long(spark):
    long = "https://www.a.org/x?" + "&".join(f"utm_{i}=1&q{i}=2" for i in range(20_000))
    rows = [(1, "http://a.org/b", "keep"), (1, "http://a.org/b", "keep"), (2, long, "keep"), (3, None, "keep"), (4, "no scheme", "keep"), (5, "http://a.org/b/?utm_x=1", "keep")]
    pages = spark.createDataFrame(rows, "page_id int, url string, host string").withColumn("other", F.col("host"))
    canonical = spark.range(1).select(url_filter.canonical_url(F.lit(long))).first()[0]
    listed = spark.createDataFrame([("a.org/b",), (canonical,), (None,), ("a.org/b",)], "canonical string")
    found = url_filter.filter_urls(pages, listed).collect()
    assert sorted((r["page_id"], r["host"], r["verdict"]) for r in found) == [(1, "a.org", "block"), (1, "a.org", "block"), (2, "www.a.org", "block"), (3, "", "allow"), (4, "", "allow"), (5, "a.org", "block")]
    assert all(r["other"] == "keep" for r in found) and "utm_" not in canonical and canonical.endswith("q19999=2")
    assert {r["verdict"] for r in url_filter.filter_urls(pages, listed.limit(0)).collect()} == {"allow"}


def recall_of(found, x, asked, k):
    hits, by = 0, defaultdict(set)
    for r in found:
        by[r["query_id"]].add(r["vec_id"])
    for q in asked:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(by[q] & set(np.argsort(d, kind="stable")[:k].tolist()))
    return hits / (k * len(asked))


def test_share_follows_the_vectors(spark):
    rng = np.random.default_rng(9)
    n, asked = 6000, range(0, 6000, 100)
    clustered = rng.standard_normal((120, 24))[rng.integers(0, 120, n)] + 0.15 * rng.standard_normal((n, 24))
    shares = {}
    for name, x in (("clustered", clustered), ("random", rng.standard_normal((n, 24)))):
        rows, dim = ann.valid_vectors(vectors(spark, list(enumerate(x.tolist()))))
        index = ann.Index(rows, dim)
        shares[name] = ann.measured_share(index)
        assert recall_of(ann.search(rows.filter("vec_id % 100 = 0"), index).collect(), x, asked, ann.K) >= 0.9
    assert shares["clustered"] <= 0.1 < shares["random"]


def test_no_vectors_are_near(spark):
    rows = vectors(spark, [(100, [1.0, 2.0]), (7, [1.0, 3.0]), (8, None)])
    valid, dim = ann.valid_vectors(rows)
    assert [tuple(r) for r in ann.search(valid.filter("vec_id % 100 = 0"), ann.Index(valid, dim)).collect()] == [(100, 1, 7, 1.0)]
    assert ann.valid_vectors(vectors(spark, []))[1] == 0


def test_descent_finds_the_least_loss():
    rng = np.random.default_rng(5)
    n, d, cost = 80, 6, 0.7
    x = rng.standard_normal((n, d))
    y = (x @ rng.standard_normal(d) + 0.8 * rng.standard_normal(n) > 0).astype(int)
    sign = np.where(y == 1, 1.0, -1.0)
    w, b = quality.descend([(np.arange(d), v) for v in x], y, d, cost, rounds=2000)
    primal = lambda w, b: (w @ w + b * b) / 2 + cost * np.maximum(0, 1 - sign * (x @ w + b)).sum()
    # A plain solver of the dual: projected gradient on its box.
    z = np.hstack([x, np.ones((n, 1))]) * sign[:, None]
    gram, alpha = z @ z.T, np.zeros(n)
    step = 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(40_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
    best = z.T @ alpha
    assert primal(w, b) <= primal(best[:-1], best[-1]) * 1.001 and np.allclose(np.append(w, b), best, atol=0.02)


def test_piece_columns_are_those_of_each_unit(spark, tmp_path):
    texts = ["wonderful words of wonderful things", "", None, "  two  spaces\n", "é日本 🎈 xyzzy" * 3, STORY]
    documents(spark, *enumerate(texts)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pieces.query(spark, str(tmp_path)).collect()}
    encoder, v = pieces.Encoder(), pieces.vocabulary(pieces.MODEL)
    want = {}
    for i, t in enumerate(texts):
        units = pieces._UNITS.findall(" " + t) if t else []
        want[i] = None if t is None else [x for u, o in zip(units, encoder._occurrences(t, len(units)).tolist(), strict=True) for x in pieces.encode_unit(v, u, o, pieces.DROPOUT, pieces.SEED)]
    hashes = {r["i"]: r["h"] for r in spark.createDataFrame(list(want.items()), "i int, p array<int>").select("i", F.xxhash64("p").alias("h")).collect()}
    assert all(got[i]["n_pieces"] == len(p or []) and got[i]["pieces_hash"] == hashes[i] and got[i]["lossless"] for i, p in want.items())
