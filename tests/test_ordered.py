"""Range-cut ordered operators against plain Python, with one key holding most rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rowforge.operators import ordered as O
from rowforge.operators.intake import fair_batch, with_row_number


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    ids = rnd.sample(range(5000), 900)
    return [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(20)}", i, rnd.randrange(40)) for i in ids]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k string, id long, v int").repartition(5)


def grouped(rows):
    out = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((i, v))
    return out


@pytest.mark.parametrize("width", [1, 97, 10_000])
def test_number_rows(table, rows, width):
    got = O.number_rows(table, ["k"], ["id"], O.id_range(F.col("id"), width)).collect()
    want = {(k, i): n for k, items in grouped(rows).items() for n, (i, _) in enumerate(items, 1)}
    assert {(r.k, r.id): r.row_number for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("width, depth", [(3, 1), (97, 1), (3, 4), (200, 3)])
def test_with_previous(table, rows, width, depth):
    got = O.with_previous(table, ["k"], ["id"], ["v"], O.id_range(F.col("id"), width), depth).collect()
    want = {
        (k, i): [v for _, v in items[max(0, n - depth):n]]
        for k, items in grouped(rows).items() for n, (i, _) in enumerate(items)
    }
    assert {(r.k, r.id): [p.v for p in r.previous] for r in got} == want and len(got) == len(rows)


def test_as_of(spark, rows):
    ts = F.timestamp_seconds(F.col("id") * 600)
    left = spark.createDataFrame(rows, "k string, id long, v int").filter("v % 3 <> 0").withColumn("at", ts)
    right = spark.createDataFrame(rows, "k string, id long, v int").filter("v % 3 = 0").withColumn("from", ts).drop("id")
    got = O.as_of(left, right.withColumnRenamed("v", "w"), ["k"], "at", "from", ["w"], seconds=7200).collect()
    want = {}
    for k, items in grouped(rows).items():
        last = None
        for i, v in items:
            if v % 3 == 0:
                last = v
            else:
                want[(k, i)] = last
    assert {(r.k, r.id): r.w for r in got} == want


def test_as_of_tie_counts_as_active(spark):
    left = spark.sql("SELECT 1 AS k, timestamp'2026-01-01 10:00:00' AS at")
    right = spark.sql("SELECT 1 AS k, timestamp'2026-01-01 10:00:00' AS since, 7 AS version")
    assert O.as_of(left, right, ["k"], "at", "since", ["version"]).first().version == 7


@pytest.mark.parametrize("width", [1, 7, 100])
def test_percentiles(table, rows, width):
    got = O.percentiles(table, ["k"], "v", {"p50": 0.5, "p95": 0.95}, F.floor(F.col("v") / width)).collect()
    for r in got:
        values = sorted(v for k, _, v in rows if k == r.k)
        assert r.p50 == values[math.ceil(len(values) * 0.5) - 1] and r.p95 == values[math.ceil(len(values) * 0.95) - 1]


def test_latest(table, rows):
    got = {r.k: r.id for r in O.latest(table, ["k"], ["id"]).collect()}
    assert got == {k: items[-1][0] for k, items in grouped(rows).items()}


def test_with_next(spark):
    df = spark.sql("SELECT 'c' AS k, timestamp_seconds(x * 90000) AS at FROM VALUES (1), (2), (5), (40) t(x)")
    got = {r.at: r.next for r in O.with_next(df, ["k"], "at", "at").collect()}
    stamps = sorted(got)
    assert [got[s] for s in stamps] == stamps[1:] + [None]


def test_row_numbers_over_splits(spark):
    rows = [("f", 0, 5, "a"), ("f", 0, 6, "b"), ("f", 100, 2, "c"), ("f", 100, 3, "d"), ("f", 200, 90, "e"), ("g", 0, 9, "x")]
    landed = spark.createDataFrame(rows, "file string, _block long, _pos long, v string")
    got = {r.v: r.row_number for r in with_row_number(landed, "file").collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "x": 1}


def test_fair_batch_limits_before_the_shuffle(spark):
    jobs = spark.range(100).select(
        F.col("id").alias("job_id"), (F.col("id") % 3).alias("partner"), F.lit(1).alias("priority"),
        F.timestamp_seconds(F.col("id")).alias("received_at"),
    )
    plan = fair_batch(jobs, 3, F.lit("2026-01-01").cast("timestamp"), 60)._jdf.queryExecution().executedPlan().toString()
    limit = [i for i, line in enumerate(plan.splitlines()) if "WindowGroupLimit" in line and "Partial" in line]
    shuffle = [i for i, line in enumerate(plan.splitlines()) if "Exchange" in line]
    assert limit and shuffle and limit[0] > shuffle[0]  # below the exchange, so before it runs
