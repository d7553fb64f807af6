from __future__ import annotations

from pyspark.sql import functions as F

from notelake.operators.index import latest
from notelake.streaming.changes import IndexTable, UpdateRun, apply_changes, pending

SCHEMA = "note_id long, hash string, user_updated_time timestamp"


def rows(spark, *items):
    return spark.createDataFrame([(i, h, t) for i, h, t in items], "note_id long, hash string, t string").select("note_id", "hash", F.to_timestamp("t").alias("user_updated_time"))


def test_stream_equals_batch_and_replays_are_harmless(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    one = rows(spark, (1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:00:01"), (1, "c", "2024-01-01 00:00:02"))
    one.coalesce(1).write.parquet(src)
    index = IndexTable(spark, out, SCHEMA, ["note_id"])
    assert index.read().count() == 0
    run = lambda: apply_changes(spark.readStream.schema(SCHEMA).parquet(src), index, str(tmp_path / "cp")).awaitTermination()
    run()
    assert {(r.note_id, r.hash) for r in index.read().collect()} == {(1, "c"), (2, "b")}
    version = index.version()
    index.merge(rows(spark, (9, "z", "2024-01-01 00:00:00")), version)  # a replayed batch
    assert index.read().count() == 2
    two = rows(spark, (2, "d", "2024-01-02 00:00:00"), (3, "e", "2024-01-02 00:00:00"))
    two.coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    got = {(r.note_id, r.hash) for r in index.read().collect()}
    batch = {(r.note_id, r.hash) for r in latest(one.union(two), ["note_id"], [F.desc("user_updated_time")]).collect()}
    assert got == batch


def test_pending_drops_repeats(spark, tmp_path):
    src = str(tmp_path / "src")
    rows(spark, (1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:00"), (1, "b", "2024-01-01 01:00:00")).write.parquet(src)
    q = pending(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.format("memory").queryName("pending_changes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("pending_changes").count() == 2


def content(index):
    return {(r.note_id, r.hash) for r in index.read().collect()}


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    index = IndexTable(spark, str(tmp_path / "t"), SCHEMA, ["note_id"], buckets=8, time="user_updated_time")
    index.merge(rows(spark, *[(i, "a", "2024-01-01 00:00:00") for i in range(50)]), 0)
    change = rows(spark, (1, "b", "2024-01-02 00:00:00"), (70, "b", "2024-01-02 00:00:00"))
    # data written, but no manifest; then a manifest without its success mark
    index._newer(index.read(), change).withColumn("bucket", index.bucket).write.partitionBy("bucket").parquet(f"{index.path}/data/v1")
    spark.createDataFrame([(0, 1)], "bucket int, version long").write.parquet(f"{index.path}/manifests/v1")
    (tmp_path / "t" / "manifests" / "v1" / "_SUCCESS").unlink()
    assert index.version() == 0 and len(content(index)) == 50
    index.merge(change, 1)
    want = {(i, "a") for i in range(50) if i != 1} | {(1, "b"), (70, "b")}
    assert index.version() == 1 and content(index) == want
    assert sum(v == 1 for v in index.manifest(1).values()) <= 2  # only buckets that it touches
    index.merge(rows(spark, (1, "late", "2023-01-01 00:00:00")), 2)  # older than what is stored
    assert content(index) == want
    index.vacuum()
    assert content(index) == want and not (tmp_path / "t" / "manifests" / "v0").exists()


def test_ties_and_the_pending_set(spark, tmp_path):
    src = str(tmp_path / "src")
    same = "2024-01-01 00:00:00"
    rows(spark, (1, "b", same), (1, "a", same), (1, "c", same), (2, "x", same)).repartition(3).write.parquet(src)
    index = IndexTable(spark, str(tmp_path / "t"), SCHEMA, ["note_id"])
    apply_changes(spark.readStream.schema(SCHEMA).parquet(src), index, str(tmp_path / "cp")).awaitTermination()
    assert content(index) == {(1, "a"), (2, "x")}
    from datetime import timedelta

    late = IndexTable(spark, str(tmp_path / "u"), SCHEMA, ["note_id"])
    apply_changes(spark.readStream.schema(SCHEMA).parquet(src), late, str(tmp_path / "cq"), late=timedelta(hours=1)).awaitTermination()
    assert {i for i, _ in content(late)} == {1, 2}


def test_one_update_at_a_time():
    class Query:
        isActive = True

        def stop(self):
            self.isActive = False

    run = UpdateRun()
    first = run.start(Query)
    assert run.active() and run.start(Query) is None
    second = run.start(Query, force=True)
    assert not first.isActive and run.running is second
    second.stop()
    assert not run.active() and run.start(Query) is not None
