"""Rows take effect once, at a cost that the history does not raise; faults between writes leave no trace."""

import pytest
from pyspark.sql import functions as F

from rowforge.sinks import once as O
from rowforge.streaming import intake as S
from rowforge.streaming import runner as R

KEY, PARTS = ("id",), ("config", "day")
SCHEMA = "id long, config string, day date, v int"


def rows(spark, ids, day, config="c", v=0):
    return spark.createDataFrame([(i, config, v) for i in ids], "id long, config string, v int").select("id", "config", F.lit(day).cast("date").alias("day"), "v")


def stored(spark, path):
    return sorted(r.id for r in O.read_once(spark, path, spark.createDataFrame([], SCHEMA).schema).collect())


def test_repeats_within_and_between_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    first = O.append_once(rows(spark, [1, 2, 2, 3], "2026-01-01"), path, 0, KEY, PARTS)
    again = O.append_once(rows(spark, [2, 3, 4], "2026-01-01"), path, 1, KEY, PARTS)
    other = O.append_once(rows(spark, [1, 5], "2026-01-02"), path, 2, KEY, PARTS)
    assert (first["written"], again["written"], other["written"]) == (3, 1, 2)
    assert first["compared"] == 0 and again["compared"] >= 2 and other["compared"] == 0
    assert stored(spark, path) == [1, 1, 2, 3, 4, 5]  # a key belongs to its partition


def test_cost_does_not_grow_with_the_history(spark, tmp_path, monkeypatch):
    path, read = str(tmp_path / "t"), []
    whole = O.stored_rows
    monkeypatch.setattr(O, "stored_rows", lambda spark, path, places, *a: read.append(places) or whole(spark, path, places, *a))
    for n in range(4):
        took = O.append_once(rows(spark, range(n * 10, n * 10 + 10), f"2026-01-0{n + 1}"), path, n, KEY, PARTS)
        assert took == {"written": 10, "compared": 0, "partitions": 1}
    assert read == []
    took = O.append_once(rows(spark, range(5, 15), "2026-01-01"), path, 4, KEY, PARTS)
    assert took["written"] == 5 and read == [["config=c/day=2026-01-01"]]
    assert len(O._folders(spark, f"{path}/filters/config=c/day=2026-01-01")) <= O.KEPT_VERSIONS


@pytest.mark.parametrize("step", ["data", "filters"])
def test_fault_between_writes_and_replay(spark, tmp_path, step):
    path = str(tmp_path / "t")
    O.append_once(rows(spark, [1, 2], "2026-01-01"), path, 0, KEY, PARTS)
    O.append_once(rows(spark, [2, 3], "2026-01-01"), path, 1, KEY, PARTS)
    if step == "data":  # the filter of batch 1 was not written yet
        O._remove(spark, f"{path}/filters/config=c/day=2026-01-01/version=1")
    O.append_once(rows(spark, [2, 3], "2026-01-01"), path, 1, KEY, PARTS)
    O.append_once(rows(spark, [3, 4], "2026-01-01"), path, 2, KEY, PARTS)
    assert stored(spark, path) == [1, 2, 3, 4]


def test_handler_that_breaks_behind_its_writes(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "t", "checkpoint"))
    for n in range(3):
        rows(spark, range(n * 4, n * 4 + 6), "2026-01-01").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    told = []
    handle = R.breaking(S.idempotent_batch(KEY, path, PARTS, told), (0, 2))
    assert R.drain_with_restarts(stream, handle, checkpoint, 5) == 2
    assert stored(spark, path) == list(range(14))
    assert len(told) == 5  # three batches, two of them twice
    with pytest.raises(Exception, match="Broken"):
        R.drain_with_restarts(stream, R.breaking(S.idempotent_batch(KEY, str(tmp_path / "u"), PARTS), (0,)), str(tmp_path / "c2"), 0)


def test_empty_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    assert O.append_once(rows(spark, [], "2026-01-01"), path, 0, KEY, PARTS)["written"] == 0
    O.append_once(rows(spark, [1], "2026-01-01"), path, 1, KEY, PARTS)
    assert stored(spark, path) == [1]
