"""Files and messages arriving as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions.convert import Field
from rowforge.operators import config as G
from rowforge.operators.intake import mark_duplicates, new_rows_only, release_after
from rowforge.operators.normalize import LINEAGE, normalize
from rowforge.sinks.once import append_once
from rowforge.sinks.tables import read_table
from rowforge.sources.files import candidate, file_name, with_hash, with_intake_key
from rowforge.sources.stored import raw_lines
from rowforge.streaming.runner import write_batch

# Message topics and their key fields.
TOPICS = {"mapping.file-import": "fileJobId", "mapping.row-normalize": "rowJobId"}
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"  # content is never selected, so never read


MOST_FILES = 1000  # a handler lists the paths of its batch on the driver


def file_stream(
    spark: SparkSession, root: str, exts: str = "csv", max_files: int = MOST_FILES, archive: str | None = None
) -> DataFrame:
    """New files below the config folders of ``root``, as a listing; handlers read the bytes by split.

    ``max_files`` bounds a batch. With ``archive`` Spark moves processed files there; the
    last batch's files move when the next one runs."""
    reader = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True)
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = reader.load(root).select(
        "path", file_name(F.col("path")).alias("file_name"), F.element_at(F.split("path", "/"), -2).alias("folder"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
    )
    return files.filter(candidate(F.col("file_name"), F.col("size"), exts))


def message_stream(spark: SparkSession, topic: str, source: str, fmt: str = "kafka", **options: str) -> DataFrame:
    """(key, id) of job messages: Kafka where its connector is present, else JSON files of the same fields."""
    field = TOPICS[topic]
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", source).option("subscribe", topic)
        body = F.get_json_object(F.col("value").cast("string"), f"$.{field}")
        return raw.options(**options).load().select(F.col("key").cast("string").alias("key"), body.cast("bigint").alias("id"))
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField(field, T.LongType())])
    return spark.readStream.schema(schema).format(fmt).options(**options).load(source).select("key", F.col(field).alias("id"))


def coalesce_events(events: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """One event per key as long as repeats come within ``delay``; later ones go to the compensating scan."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def hashed(files: DataFrame) -> DataFrame:
    """A batch of files with the hash of their bytes, read by split; the paths of a batch are bounded by ``max_files``."""
    if "content_hash" in files.columns:
        return files
    paths = [r.path for r in files.select("path").distinct().collect()]
    if not paths:
        return files.withColumn("content_hash", F.lit(None).cast("string"))
    return with_hash(files, raw_lines(files.sparkSession, paths), "content_hash")


def intake_batch(configs: DataFrame, activations: DataFrame, registry: str, warnings: str):
    """Handler: pin the version active at receipt, find duplicates, write jobs. Folders without a config, and
    configs without an active version, only warn.

    Receipt is when the batch is first handled, stored with its jobs; a replay keeps that time.

    Only one intake query may own a registry, as nothing else stops two writers from both
    calling the same content new."""

    def handle(files: DataFrame, batch_id: int) -> None:
        spark = files.sparkSession
        files = hashed(files).persist()
        known = files.join(configs.select("folder", "config_id"), "folder")
        keyed = with_intake_key(known, F.col("config_id"))
        stored = read_table(spark, registry)
        first = stored.filter(F.col("batch_id") == batch_id).agg(F.min("received_at")).first()[0] if stored is not None else None
        received = first or spark.range(1).select(F.current_timestamp()).first()[0]
        pinned = G.pin_version(keyed.withColumn("received_at", F.lit(received).cast("timestamp")), activations).persist()
        known_version = pinned.filter(F.col("version_id").isNotNull())
        jobs = known_version.withColumn("file_job_id", F.sha2("intake_key", 256)).dropDuplicates(["intake_key"])
        if stored is not None:
            stored = stored.filter(F.col("batch_id") != batch_id).drop("batch_id")
            jobs = new_rows_only(jobs, stored, ("intake_key",))
        else:
            stored = jobs.withColumn("import_status", F.lit("Queued")).limit(0)
        marked = mark_duplicates(
            jobs, stored.select("config_id", "content_hash", "file_job_id", "import_status"),
            ["config_id", "content_hash"], ["mtime", "file_job_id"],
        )
        write_batch(marked, registry, batch_id)
        lost = files.join(configs.select("folder"), "folder", "left_anti").withColumn("warning", F.lit("NoActiveConfig"))
        idle = pinned.filter(F.col("version_id").isNull()).withColumn("warning", F.lit("NoActiveVersion"))
        cols = ("folder", "path", "warning")
        write_batch(lost.select(*cols).unionByName(idle.select(*cols)), warnings, batch_id)
        pinned.unpersist()
        files.unpersist()

    return handle


def normalize_batch(fields: list[Field], path: str, keep: tuple[str, ...] = LINEAGE):
    """Handler: typed results of newly arrived Source rows, before their file is complete."""

    def handle(rows: DataFrame, batch_id: int) -> None:
        write_batch(normalize(rows, fields, keep), path, batch_id)

    return handle


def idempotent_batch(key: tuple[str, ...], path: str, parts: tuple[str, ...], told: list[dict] | None = None):
    """Handler: rows whose key no other batch wrote yet. Messages may come any number of times, in their own partitions ``parts``.

    ``told`` collects what each batch took."""

    def handle(rows: DataFrame, batch_id: int) -> None:
        took = append_once(rows, path, batch_id, key, parts)
        if told is not None:
            told.append(took)

    return handle


def hold_batch(hold: str, released: str, now, seconds: int = 30):
    """Handler: keep taken jobs in a hold table and release those whose hold is over.

    A later event for a held job never restarts its hold: the earliest taken_at counts."""

    def handle(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        write_batch(rows.select("job_id", "taken_at"), hold, batch_id)
        held = spark.read.parquet(hold).groupBy("job_id").agg(F.min("taken_at").alias("taken_at"))
        due = release_after(held, now(rows), seconds)
        gone = read_table(spark, released)
        if gone is not None:
            due = new_rows_only(due, gone.filter(F.col("batch_id") != batch_id), ("job_id",))
        write_batch(due, released, batch_id)

    return handle
