"""One key with a third of all rows: results stay whole and the hot key is split."""

import pytest
from pyspark.sql import functions as F

from rowforge.operators import intake as I
from rowforge.operators import lookup as J
from rowforge.operators import ordered as O

SMALL = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    "spark.sql.shuffle.partitions": "64",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def small_limits(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.fixture
def files(spark):
    """300 000 deliveries; a third of them have the same content."""
    n = F.col("id")
    return spark.range(300_000, numPartitions=8).select(
        n.alias("file_job_id"), F.sha2(F.when(n % 3 == 0, "hot").otherwise((n % 50_000).cast("string")), 256).alias("content_hash")
    )


def test_hot_content_is_split_over_tasks(spark, files, small_limits):
    named = files.withColumn("path", F.sha2(F.col("file_job_id").cast("string"), 256))
    out = I.first_wins(named, ["content_hash"], ["file_job_id"])
    counted = out.groupBy("delivery").agg(F.count("path").alias("count"), F.max("path"))
    distinct = files.select("content_hash").distinct().count()
    assert {r.delivery: r["count"] for r in counted.collect()} == {"First": distinct, "Duplicate": 300_000 - distinct}
    assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_the_hot_group_when_numbering(spark, files):
    hot = files.withColumn("folder", F.when(F.col("file_job_id") % 3 == 0, "hot").otherwise(F.col("content_hash")))
    numbered = O.number_rows(hot, ["folder"], ["file_job_id"], O.id_range(F.col("file_job_id"), 10_000))
    biggest = numbered.groupBy(F.spark_partition_id().alias("p"), "folder").count().agg(F.max("count")).first()[0]
    assert numbered.filter("folder = 'hot'").agg(F.max("row_number")).first()[0] == 100_000
    # the hot folder is cut into 30 ranges, spread over the tasks
    assert biggest < 60_000


def test_hot_reference_key_keeps_every_row(spark, files, small_limits):
    ref = files.select("content_hash").distinct().limit(40_000)
    kept = J.lookup(files, ref, ["content_hash"], "exists").count()
    lost = J.lookup(files, ref, ["content_hash"], "missing").count()
    assert kept + lost == 300_000
