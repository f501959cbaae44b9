"""The registered queries against SQL, brute force and held-out labels."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from oracle import of_spark, of_sql

from corpusloom.llm import ann, pieces, pii, queries, suffix_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert of_spark(queries.QUERIES[name](spark, sf)) == of_sql(queries.SQL[name], sf)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op2_classify_quality"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    seen = [r for r in rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect() if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in seen]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in seen)


def test_pieces_decode(spark, sf, docs):
    rows = queries.QUERIES["op3_encode_pieces"](spark, sf).collect()
    assert len(rows) == len(docs) and all(r["lossless"] for r in rows)
    assert sum(r["n_chars"] for r in rows) == sum(len(t or "") for _, t in docs)


def plain_pii(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for i, (kind, form) in enumerate(kinds.items()):
        for m in re.finditer(form, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0, "phone": 9 <= len(d) <= 15}
            if good[kind]:
                found.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


def test_pii_equals_expressions(spark, sf, docs):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op5_find_pii"](spark, sf).collect()}
    for i, t in docs:
        base = plain_pii(t or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(rows[i]["spans"].split(",")) | {""}
    assert sum(r["n_email"] + r["n_card"] + r["n_phone"] for r in rows.values()) > 0
    odd = "x@y@z.co a@b.c@d.e 1.2.3.4.5 1.2.3.999 card 4111 1111 1111 1111 or +1 (743) 555-3824 +1 IBAN: GB82 WEST 1234 5698 7654 32 account no. 12345678 SSN 123-45-6789 ftp://me:pw@host.org/"
    assert [f"{k}:{s}:{e}" for k, s, e in pii.spans(odd) if k in pii.BASE] == plain_pii(odd)
    assert {k for k, _, _ in pii.spans(odd)} >= {"iban", "account", "ssn", "login", "email", "card", "phone"}


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, sf, docs):
    rows = queries.QUERIES["op8_remove_repeats"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted((i, *x) for (i, _), x in zip(docs, brute_repeats([t for _, t in docs], suffix_dedup.LENGTH), strict=True))


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def test_near_duplicates_against_all_pairs(spark, sf, docs):
    found = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op9_near_duplicates"](spark, sf).collect()}
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids if a < b and sets[a] & sets[b]}
    assert all(found[a] == found[b] for (a, b), j in alike.items() if j >= 0.84)
    near = defaultdict(float)
    for (a, b), j in alike.items():
        if found[a] == found[b]:
            near[a], near[b] = max(near[a], j), max(near[b], j)
    assert all(near[i] > 0.76 or not sets[i] for i in ids if found[i] != i)
    assert any(found[i] != i for i in ids)


def test_nearest_vectors(spark, sf):
    rows = queries.QUERIES["op10_nearest_vectors"](spark, sf).collect()
    table = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    hits = 0
    by = defaultdict(list)
    for r in rows:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {i for i in table if i % 100 == 0}
    for q, got in by.items():
        got.sort()
        true = sorted((float(np.sqrt(((v - table[q]) ** 2).sum())), i) for i, v in table.items() if i != q)[: ann.K]
        hits += len({i for _, i in true} & {i for _, i, _ in got})
        assert [k for k, _, _ in got] == list(range(1, ann.K + 1)) and [(s, i) for _, i, s in got] == sorted((s, i) for _, i, s in got)
        assert all(s == pytest.approx(float(np.sqrt(((table[i] - table[q]) ** 2).sum())), abs=1e-12) for _, i, s in got)
    assert hits >= 0.9 * ann.K * len(by)


def test_dropout_varies_and_zero_is_the_library(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for _, t in docs[:60]] + ["", "  two  spaces ", "日本語 テスト\n\n x", "a\x00b", "x" * 300, "①é́"]
    assert [x.tolist() for x in pieces.Encoder(dropout=0).encode(texts)] == [model.encode(t) for t in texts]
    one, same, other = (pieces.Encoder(seed=s).encode(texts) for s in (1, 1, 2))
    assert all((a == b).all() for a, b in zip(one, same, strict=True))
    assert any(len(a) != len(b) or (a != b).any() for a, b in zip(one, other, strict=True))
    v = pieces.vocabulary(pieces.MODEL)
    assert [pieces.decode_ids(v, x) for x in one] == texts
    units = [("▁", 0), (" the", 1), ("  wonder", 2), ("ful", 3), (" " + "ab" * 60, 0)]
    ids, sizes = pieces.encode_units(v, units, 0.3, 5)
    assert ids.tolist() == [i for u, k in units for i in pieces.encode_unit(v, u, k, 0.3, 5)] and sizes.sum() == len(ids)
