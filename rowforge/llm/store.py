"""Written tables in the folder that all executors share."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from rowforge.session import fresh_path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, removed when the session's JVM ends."""
    path = fresh_path(spark, f"llm-{name}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: a lost executor never repeats what lies before it."""
    spark = df.sparkSession
    path = shared_folder(spark, name) + "/table"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):  # it goes at the session's end anyway
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
