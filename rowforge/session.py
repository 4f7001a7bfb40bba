"""Session settings and the shared folder used for staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators count on. AQE splits the hot partitions of
# shuffle joins and turns small shuffled sides into broadcasts by measured size.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # cp874 and other partner code pages are refused without this
    "spark.sql.legacy.javaCharsets": "true",
    # many folders are listed by so many tasks, not by one task a folder
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}


def build_session(app: str = "rowforge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; local runs get one of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rowforge-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/rowforge/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Raw rows over all cores when the scan has fewer splits than there are cores.

    Conversions cost far more than moving a small input once. A large input has more splits
    than cores and is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ends_with_session(spark: SparkSession, path: str) -> None:
    """Remove what lies at ``path`` when the session's JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: fixed rows, no lineage, pruned columns. The table goes with the session."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    ends_with_session(spark, path)
    return spark.read.schema(df.schema).parquet(path)
