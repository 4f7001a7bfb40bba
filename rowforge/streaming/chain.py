"""From delivered files to typed rows in two streams that follow each other.

The first stream takes new files, stores their lines and writes numbered Source rows, a share of each file's
splits at a time; a marker with the number of rows follows once a file is complete. The second stream starts on
Source rows as soon as a share is written, whether their file is complete or not. Each has its own checkpoint,
both write through ``append_once``, so either may break anywhere and go on. A file is done when its marker is
there and as many rows were normalized as it tells.

    lines/batch_id=<n>     bytes as first read, used again by a replay
    source/data            Source rows (config_id, day, batch_id)
    markers/batch_id=<n>   file_job_id, config_id, total_rows
    results/data           typed rows and their errors"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions.convert import Field
from rowforge.operators.normalize import normalize
from rowforge.operators.skew import attach
from rowforge.session import stage
from rowforge.sinks.once import append_once
from rowforge.sinks.tables import read_table
from rowforge.sources import csv as S
from rowforge.sources import files as L
from rowforge.sources import stored
from rowforge.streaming.runner import write_batch

PARTS = ("config_id", "day")
KEY = ("file_job_id", "row_number")


def source_schema(rules: list[tuple[str, str]]) -> T.StructType:
    named = "file_job_id string, row_number long, " + ", ".join(f"{s} string" for _, s in rules)
    return T.StructType([*T.StructType.fromDDL(named), *T.StructType.fromDDL("config_id long, day date")])


def _snapshot(spark: SparkSession, files: DataFrame, path: str, batch_id: int) -> L.Snapshot | None:
    """Lines of a batch's files, stored by the first attempt and read by every later one."""
    folder = f"{path}/lines/batch_id={batch_id}"
    lines = read_table(spark, folder)
    if lines is None:
        paths = [r.path for r in files.select("path").distinct().collect()]  # at most max_files of the stream
        if not paths:
            return None
        stored.store_lines(spark, paths).write.mode("overwrite").parquet(folder)
        lines = spark.read.parquet(folder)
    return L.Snapshot(lines, stored.splits(lines), lines.select(F.col("file").alias("path")).distinct())


def import_batch(path: str, rules: list[tuple[str, str]], configs: DataFrame, shares: int = 4, after_share: Callable[[int, int], None] | None = None):
    """Handler of a file listing (path, folder, mtime): Source rows of its files in ``shares`` commits, then their markers.

    ``configs`` (folder, config_id) tells the config of a file; files of other folders are left to ``intake_batch``,
    which warns of them. ``after_share`` is called behind each commit."""

    def handle(files: DataFrame, batch_id: int) -> None:
        spark = files.sparkSession
        known = stage(files.join(configs.select("folder", "config_id"), "folder"), "arrived")
        snapshot = _snapshot(spark, known, path, batch_id)
        if snapshot is None:
            return
        landed = S.parse(snapshot)
        heads = S.headers(landed)
        rows = S.records(landed, heads, rules).withColumn("_path", L.decoded_path(F.col("file")))
        jobs = known.select(F.col("path").alias("_path"), F.sha2(F.concat_ws("|", "path", F.unix_micros("mtime")), 256).alias("file_job_id"), F.col("config_id").cast("long").alias("config_id"), F.to_date("mtime").alias("day"))
        source = stage(attach(rows, jobs, ["_path"], "inner").withColumn("row_number", F.col("row_number").cast("long")).select(*source_schema(rules).fieldNames()), "source-rows")
        totals = source.groupBy("file_job_id").agg(F.count(F.lit(1)).alias("total_rows"))
        size = F.ceil(F.col("total_rows") / shares)
        shared = stage(attach(source, totals, ["file_job_id"]).withColumn("_share", F.floor((F.col("row_number") - 1) / size)), "shares")  # joined once, read for every share
        for share in range(shares):
            part = shared.where(F.col("_share") == share).select(*source.columns)
            append_once(part, f"{path}/source", batch_id * shares + share, KEY, PARTS)
            if after_share is not None:
                after_share(batch_id, share)
        write_batch(jobs.join(totals, "file_job_id", "left").select("file_job_id", "config_id", F.coalesce("total_rows", F.lit(0)).alias("total_rows")), f"{path}/markers", batch_id)

    return handle


def source_stream(spark: SparkSession, path: str, rules: list[tuple[str, str]], max_files: int = 1000) -> DataFrame:
    """Source rows as their shares are committed. A share that a replay had to write again comes twice; the next sink drops it."""
    folder = f"{path}/source/data"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return (
        spark.readStream.schema(T.StructType([*source_schema(rules), T.StructField("batch_id", T.LongType())]))
        .option("maxFilesPerTrigger", max_files).option("ignoreMissingFiles", True).parquet(folder).drop("batch_id")
    )


def results_batch(path: str, fields: list[Field]):
    """Handler of Source rows: their typed results, once each."""

    def handle(rows: DataFrame, batch_id: int) -> None:
        append_once(normalize(rows, fields, (*KEY, *PARTS)), f"{path}/results", batch_id, KEY, PARTS)

    return handle


def results(spark: SparkSession, path: str) -> DataFrame | None:
    return read_table(spark, f"{path}/results/data")


def file_progress(spark: SparkSession, path: str) -> DataFrame:
    """(file_job_id, normalized, total_rows, complete) of every file with rows or a marker."""
    done = results(spark, path).groupBy("file_job_id").agg(F.count(F.lit(1)).alias("normalized"))
    markers = read_table(spark, f"{path}/markers")
    if markers is None:
        return done.select("*", F.lit(None).cast("long").alias("total_rows"), F.lit(False).alias("complete"))
    both = done.join(markers.select("file_job_id", "total_rows"), "file_job_id", "full")
    return both.select(
        "file_job_id", F.coalesce("normalized", F.lit(0)).alias("normalized"), "total_rows",
        F.coalesce(F.col("total_rows") == F.coalesce("normalized", F.lit(0)), F.lit(False)).alias("complete"),
    )
