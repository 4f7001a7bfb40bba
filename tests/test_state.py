"""Stateful streams over several batches: same answers for any number of batches, and nothing kept that is settled."""

import random

import pytest
from pyspark.sql import functions as F

from rowforge.streaming import runner as R
from rowforge.streaming import state as H

SECOND = 1_000_000


def at(us):
    return F.timestamp_micros(us)


def drained(spark, tmp_path, rows, schema, stream, batches, out_schema):
    """Rows dealt into ``batches`` drains under one checkpoint."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for k in range(batches):
        part = rows[k * len(rows) // batches : (k + 1) * len(rows) // batches]
        frame = spark.createDataFrame(part, schema)
        typed = frame.select(*[at(F.col(c)).alias(c[:-3]) if c.endswith("_us") else F.col(c) for c in frame.columns])
        typed.coalesce(2).write.mode("append").parquet(folder)
        R.drain(stream(spark.readStream.schema(typed.schema).parquet(folder)), out, checkpoint)
    return spark.read.schema(out_schema).parquet(out).collect()


def ready_times(rows, n=3):
    out = {}
    for path in {r[0] for r in rows}:
        seen = sorted((t, s, m) for p, t, s, m in rows if p == path)
        run = 0
        for k, (t, s, m) in enumerate(seen):
            run = run + 1 if k and seen[k - 1][1:] == (s, m) else 1
            if run == n:
                out[path] = t
                break
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_readiness_does_not_depend_on_batches(spark, tmp_path, batches):
    R.use_rocksdb(spark)
    rng = random.Random(1)
    rows = [(f"p{rng.randrange(5)}", rng.randrange(100 * SECOND), rng.randrange(2), 1) for _ in range(80)]
    want = ready_times(rows)
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(20 * SECOND)) + [("clock", 1000 * SECOND, 0, 0)]
    got = drained(
        spark, tmp_path, arrival, "path string, observed_at_us long, size long, mtime long",
        lambda s: H.readiness_stream(s, 3, "30 seconds", 10**9), batches, "path string, ready_at timestamp",
    )
    assert len(got) == len(want) > 3
    assert {r.path: round(r.ready_at.timestamp() * 1e6) for r in got} == want


def nearest(notices, message, reach):
    near = sorted((abs(t - message[2]), t, i) for k, _, t, i in notices if k == message[0] and abs(t - message[2]) <= reach)
    return None if not near else (near[0][2], near[0][1])


@pytest.mark.parametrize("batches", [1, 3])
def test_every_message_meets_its_nearest_notice(spark, tmp_path, batches):
    R.use_rocksdb(spark)
    rng, reach = random.Random(2), 10
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice(["notice", "notice", "confirm", "cancel"]), (100 + rng.randrange(200)) * SECOND, i) for i in range(150)]
    rows.append((9, "cancel", 150 * SECOND, 900))
    arrival = sorted(rows, key=lambda r: r[2] + rng.randrange(15 * SECOND)) + [(-1, "notice", 2000 * SECOND, -1)]
    got = drained(
        spark, tmp_path, [(k, kind, i, t) for k, kind, t, i in arrival], "business_key long, kind string, id long, at_us long",
        lambda s: H.correlate_stream(s, reach, "20 seconds"), batches, "business_key long, message_id long, kind string, notice_id long, outcome string",
    )
    notices, want = [r for r in rows if r[1] == "notice"], {}
    for r in rows:
        if r[1] != "notice":
            n = nearest(notices, r, reach * SECOND)
            want[r[3]] = (r[1], None, "Orphan") if n is None else (r[1], n[0], "OutOfOrder" if n[1] > r[2] else "InOrder")
    assert len(got) == len(want)
    assert {r.message_id: (r.kind, r.notice_id, r.outcome) for r in got} == want
    assert {v[2] for v in want.values()} == {"Orphan", "OutOfOrder", "InOrder"}


def test_hold_ends_by_the_clock_and_leaves_no_state(spark, tmp_path):
    R.use_rocksdb(spark)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    jobs = spark.range(4).select(F.col("id").alias("job_id"), F.current_timestamp().alias("taken_at"))
    jobs = spark.createDataFrame(jobs.collect() + jobs.limit(1).collect(), jobs.schema)
    jobs.write.parquet(folder)
    R.run_until(H.hold_stream(spark.readStream.schema(jobs.schema).parquet(folder), 3, remember_ms=500), out, str(tmp_path / "checkpoint"), seconds=60)
    got = spark.read.schema("job_id long, released_ms long").parquet(out).collect()
    taken = {r.job_id: int(r.taken_at.timestamp() * 1000) for r in jobs.groupBy("job_id").agg(F.min("taken_at").alias("taken_at")).collect()}
    assert sorted(r.job_id for r in got) == [0, 1, 2, 3]
    assert all(r.released_ms - taken[r.job_id] - 3000 in (-1, 0, 1) for r in got)


def test_hold_runs_as_long_as_jobs_come_and_takes_nulls(spark, tmp_path):
    R.use_rocksdb(spark)
    folder = str(tmp_path / "in")
    jobs = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).alias("job_id"), F.when(F.col("id") > 0, at(F.col("id") * SECOND)).alias("taken_at"))
    jobs.repartition(5, "job_id").write.option("maxRecordsPerFile", 1).parquet(folder)
    stream = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    # five batches and more take longer in all than the time allowed without any change
    R.run_until(H.hold_stream(stream, 3, remember_ms=500), out, str(tmp_path / "checkpoint"), seconds=5)
    got = spark.read.schema("job_id long, released_ms long").parquet(out).collect()
    assert {(r.job_id, r.released_ms) for r in got} == {(0, None), (1, 4000), (2, 5000), (3, 6000), (None, 7000)}
    assert len(got) == 5
