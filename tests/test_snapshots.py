"""Snapshot commits: crashes between any two steps, conflicts, replayed batches, order columns."""

import pytest

from corpusloom.sources.snapshots import Conflict, Snapshots, reload_edges
from corpusloom.streaming.ingest import upsert_stream


class Crash(RuntimeError):
    pass


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k int, v string, at int")


def have(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("step, done", [("data", False), ("pointer", False), ("published", True), ("vacuumed", True)])
def test_a_crash_leaves_a_readable_table(spark, tmp_path, step, done):
    root = f"file://{tmp_path}/t"
    Snapshots(spark, root).upsert("rows", rows(spark, (1, "a", 1)), ["k"])
    held = Snapshots(spark, root).read("rows")

    def crash(s):
        if s == step:
            raise Crash

    with pytest.raises(Crash):
        Snapshots(spark, root, after=crash).upsert("rows", rows(spark, (2, "b", 1)), ["k"])
    now = Snapshots(spark, root)
    assert have(now.read("rows")) == ([(1, "a", 1), (2, "b", 1)] if done else [(1, "a", 1)]) and have(held) == [(1, "a", 1)]
    now.upsert("rows", rows(spark, (3, "c", 1)), ["k"])
    assert have(now.read("rows"))[-1] == (3, "c", 1) and now.read("rows", now.pointer()["version"] - 1) is not None
    assert now.sweep() == (0 if done else 2 if step == "pointer" else 1) and have(now.read("rows"))[-1] == (3, "c", 1)


def test_versions_conflicts_and_vacuum(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t", keep=2)
    assert s.read("rows") is None
    for i in range(4):
        s.upsert("rows", rows(spark, (i, "x", i)), ["k"])
    assert s.pointer()["version"] == 4 and s.read("rows").count() == 4 and s.read("rows", 3).count() == 3
    assert len(list((tmp_path / "t/data").iterdir())) == 2
    base = s.pointer()
    s.commit({"other": rows(spark, (9, "o", 9))}, base)
    with pytest.raises(Conflict):
        s.commit({"rows": rows(spark, (9, "lost", 9))}, base)
    assert s.read("rows").count() == 4 and s.read("other").count() == 1


def test_the_last_row_by_the_order_column_wins(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t")
    s.upsert("rows", rows(spark, (1, "zebra", 1), (1, "apple", 2), (2, "b", 5)), ["k"], "at")
    assert have(s.read("rows")) == [(1, "apple", 2), (2, "b", 5)]
    s.upsert("rows", rows(spark, (1, "new", 3), (2, "late", 4)), ["k"], "at")
    assert have(s.read("rows")) == [(1, "new", 3), (2, "b", 5)]


def test_a_replayed_batch_does_nothing(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t")
    assert s.upsert("rows", rows(spark, (1, "a", 1)), ["k"], batch=("x", 0)) == 1
    assert s.upsert("rows", rows(spark, (1, "b", 1)), ["k"], batch=("x", 0)) is None
    assert s.upsert("rows", rows(spark, (2, "c", 1)), ["k"], batch=("y", 0)) == 2 and have(s.read("rows")) == [(1, "a", 1), (2, "c", 1)]


def test_stream_restarts_where_it_was(spark, tmp_path):
    root, cp = f"file://{tmp_path}/out", f"file://{tmp_path}/cp"

    def run():
        stream = spark.readStream.schema("k int, v string, at int").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        upsert_stream(stream, root, ["k"], cp, order="at").awaitTermination()

    rows(spark, (1, "zebra", 1), (1, "apple", 2)).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    run()
    rows(spark, (1, "late", 0), (2, "b", 1)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    run()
    s = Snapshots(spark, root)
    assert have(s.read("rows")) == [(1, "apple", 2), (2, "b", 1)] and s.pointer()["batches"] == {cp: 1}
    (tmp_path / "cp/commits/1").unlink()  # as if the stream had died right after the table was published
    (tmp_path / "cp/commits/.1.crc").unlink(missing_ok=True)
    run()
    assert Snapshots(spark, root).pointer()["version"] == 2


def test_edges_are_replaced_together(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    explicit = spark.createDataFrame([("a", "b", 1), ("a", "b", 3), ("b", "c", 1)], "src string, dst string, weight int")
    semantic = spark.createDataFrame([("a", "c", 0.9)], "src string, dst string, similarity double")
    assert reload_edges(root, explicit, semantic, dry_run=True) == (2, 1) and Snapshots(spark, root).pointer()["version"] == 0
    assert reload_edges(root, explicit, semantic) == (2, 1)
    assert reload_edges(root, explicit.limit(0), semantic) == (0, 1) and Snapshots(spark, root).read("explicit_edges", 1).count() == 2
