"""Streams: folder intake with duplicates and restart, hold, messages, archive."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rowforge.streaming import intake as S
from rowforge.streaming import runner as R
from rowforge.streaming import state as H


@pytest.fixture
def configs(spark):
    rows = spark.createDataFrame([("orders", 1), ("parts", 2)], "folder string, config_id int")
    day = F.expr("INTERVAL 1 DAY")
    activations = rows.select("config_id", (F.current_timestamp() - day).alias("activated_at"), (F.col("config_id") * 10).alias("version_id"))
    return rows, activations


def put(root, folder, name, text):
    os.makedirs(f"{root}/{folder}", exist_ok=True)
    with open(f"{root}/{folder}/{name}", "w") as f:
        f.write(text)


def test_folder_intake(spark, configs, tmp_path):
    root, registry, warnings, checkpoint = (str(tmp_path / n) for n in ("in", "registry", "warnings", "checkpoint"))
    put(root, "orders", "a.csv", "x\n1\n")
    put(root, "orders", "b.csv", "x\n2\n")
    put(root, "stray", "c.csv", "x\n1\n")
    put(root, "orders", "skip.txt", "x\n")

    def drain():
        R.drain_batches(S.file_stream(spark, root), S.intake_batch(*configs, registry, warnings), checkpoint)

    drain()
    put(root, "orders", "copy_of_a.csv", "x\n1\n")
    put(root, "parts", "a.csv", "x\n1\n")
    drain()
    drain()
    got = {(r.folder, r.file_name): (r.import_status, r.version_id) for r in spark.read.parquet(registry).collect()}
    assert got == {
        ("orders", "a.csv"): ("Queued", 10), ("orders", "b.csv"): ("Queued", 10),
        ("orders", "copy_of_a.csv"): ("Duplicate", 10), ("parts", "a.csv"): ("Queued", 20),
    }
    assert [(r.folder, r.warning) for r in spark.read.parquet(warnings).collect()] == [("stray", "NoActiveConfig")]


def test_replayed_batch_changes_nothing(spark, configs, tmp_path):
    registry, warnings = str(tmp_path / "registry"), str(tmp_path / "warnings")
    files = spark.createDataFrame(
        [("p/a.csv", "a.csv", "orders", 5, "h")], "path string, file_name string, folder string, size long, content_hash string"
    ).withColumn("mtime", F.current_timestamp())
    files = spark.createDataFrame(files.collect(), files.schema)
    handle = S.intake_batch(*configs, registry, warnings)
    handle(files, 0)
    handle(files, 0)
    assert [r.import_status for r in spark.read.parquet(registry).collect()] == ["Queued"]
    handle(files, 1)  # the same event again in a later batch
    assert spark.read.parquet(registry).count() == 1


def test_hold_is_not_restarted(spark, tmp_path):
    hold, released = str(tmp_path / "hold"), str(tmp_path / "released")
    at = lambda s: f"2026-01-01 10:00:{s:02d}"
    clock = {"now": at(0)}
    handle = S.hold_batch(hold, released, lambda df: F.lit(clock["now"]).cast("timestamp"))
    rows = lambda *xs: spark.createDataFrame(xs, "job_id int, t string").select("job_id", F.col("t").cast("timestamp").alias("taken_at"))
    out = lambda: sorted(r.job_id for r in spark.read.parquet(released).collect())
    for batch, (now, arrivals) in enumerate([(5, [(1, at(0))]), (29, [(1, at(20)), (2, at(25))]), (31, [(3, at(30))]), (56, [(1, at(50))])]):
        clock["now"] = at(now)
        handle(rows(*arrivals), batch)
        assert out() == {0: [], 1: [], 2: [1], 3: [1, 2]}[batch]


def test_messages_from_files(spark, tmp_path):
    folder = tmp_path / "messages"
    folder.mkdir()
    (folder / "m.json").write_text("".join(json.dumps({"key": str(i), "fileJobId": i}) + "\n" for i in range(3)))
    out = R.to_table(S.message_stream(spark, "mapping.file-import", str(folder), "json"), "messages")
    assert {(r.key, r.id) for r in out.collect()} == {("0", 0), ("1", 1), ("2", 2)}


def test_processed_files_are_archived(spark, tmp_path):
    root, archive = str(tmp_path / "in"), str(tmp_path / "done")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for name in ("a.csv", "b.csv"):
        put(root, "orders", name, f"x\n{name}\n")
        R.drain(S.file_stream(spark, root, archive=archive).select("file_name"), out, checkpoint)
    put(root, "orders", "c.csv", "x\n3\n")
    R.drain(S.file_stream(spark, root, archive=archive).select("file_name"), out, checkpoint)
    assert {r.file_name for r in spark.read.parquet(out).collect()} == {"a.csv", "b.csv", "c.csv"}
    moved = {n for _, _, names in os.walk(archive) for n in names}
    assert "a.csv" in moved and "c.csv" not in moved  # the last batch moves with the next one


def test_repeats_within_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = spark.createDataFrame([("k", 1), ("k", 2), ("j", 3)], "key string, s int").select("key", F.timestamp_seconds("s").alias("at"))
    rows.write.parquet(folder)
    once = S.coalesce_events(spark.readStream.schema(rows.schema).parquet(folder), ["key"], "at", "1 hour")
    assert sorted(r.key for r in R.to_table(once, "once").collect()) == ["j", "k"]


def test_readiness_over_batches(spark, tmp_path):
    R.use_rocksdb(spark)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("seen", "ready", "checkpoint"))
    schema = "path string, observed_at timestamp, size long, mtime long"
    for i, size in enumerate([5, 9, 9, 9, 9]):
        spark.createDataFrame([("p", size)], "path string, size long").select(
            "path", F.timestamp_seconds(F.lit(i)).alias("observed_at"), "size", F.lit(1).cast("long").alias("mtime")
        ).write.mode("append").parquet(folder)
        R.drain(H.readiness_stream(spark.readStream.schema(schema).parquet(folder)), out, checkpoint)
    assert [(r.path, r.ready_at.second) for r in spark.read.schema("path string, ready_at timestamp").parquet(out).collect()] == [("p", 3)]
