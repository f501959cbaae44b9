"""One JSON array, cut into many byte ranges."""

import json
import random

import pytest
from pyspark.sql import types as T

from corpusloom.sources import json_array

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType()), T.StructField("l", T.ArrayType(T.StringType())), T.StructField("m", T.MapType(T.StringType(), T.StructType([T.StructField("x", T.StringType())])))])
ODD = ["", "}", "{", "]", "[", '"', "\\", '\\"', "}\\", '"},{"', "},\n{", "é😀}", "a\\\\}", "\t\n}", '{"a": 1}', "x" * 300 + "}" * 50]


def made(n, seed=1):
    rng = random.Random(seed)
    return [{"a": "".join(rng.choices(ODD, k=rng.randrange(5))), "n": i, "l": rng.choices(ODD, k=rng.randrange(4)), "m": {c: {"x": c} for c in rng.choices(ODD, k=rng.randrange(3))}} for i in range(n)]


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plain(r):
    return {"a": r["a"], "n": r["n"], "l": r["l"], "m": {k: {"x": v["x"]} for k, v in r["m"].items()}}


@pytest.mark.parametrize("indent, ascii", [(None, True), (2, False)])
def test_many_tasks_keep_places(spark, tmp_path, small_ranges, indent, ascii):
    records = made(120)
    (tmp_path / "r.json").write_text(json.dumps(records, indent=indent, ensure_ascii=ascii) + "\n")
    df = json_array.read_records(spark, f"file://{tmp_path}/r.json", SCHEMA)
    assert spark.read.option("lineSep", "}").text(f"file://{tmp_path}/r.json").rdd.getNumPartitions() > 20
    got = {r["section_ord"]: plain(r) for r in df.collect()}
    assert got == dict(enumerate(records))
    first = json_array.read_records(spark, f"file://{tmp_path}/r.json", SCHEMA, limit=7).collect()
    assert sorted(r["section_ord"] for r in first) == list(range(7))


def test_long_records_and_several_files(spark, tmp_path, small_ranges):
    long = [{"a": "}{" * 2000, "n": 0, "l": ["[" * 700], "m": {}}, {"a": "b", "n": 1, "l": [], "m": {}}, {"a": '"' * 900, "n": 2, "l": [], "m": {}}]
    for i, records in enumerate([long, made(5, 2), long[1:2]]):
        (tmp_path / f"{i}.json").write_text(" \n" + json.dumps(records))
    got = [(r["section_ord"], json.dumps(plain(r))) for r in json_array.read_records(spark, f"file://{tmp_path}", SCHEMA).collect()]
    assert sorted(got) == sorted((k, json.dumps(r)) for records in (long, made(5, 2), long[1:2]) for k, r in enumerate(records))


@pytest.mark.parametrize("text", ["[]", "", "7", '["a"]', '{"a": "x"}', '[{"a": "x"}, 7, {"a": "y"}]', '[{"a": "x"}', '[{"a": "x"}, {"a": ]'])
def test_anything_else_is_an_error(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="."):
        json_array.read_records(spark, f"file://{tmp_path}/bad.json", SCHEMA).collect()
