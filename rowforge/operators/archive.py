"""Archive plan, archive status and work that can be repeated without mapping again."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.functions.arrays import present
from rowforge.functions.keys import archive_path
from rowforge.operators.ordered import number_rows
from rowforge.session import ends_with_session, fresh_path, stage
from rowforge.sinks.publish import Files

MOVED = "path string, archive_path string, archive_status string, reason string"


def archive_status(live: DataFrame, snapshot: DataFrame, key: str = "file_job_id") -> DataFrame:
    """Equal bytes may be archived; changed bytes stay for a person to decide.

    ``live`` has live_hash, ``snapshot`` sha256. A file gone from its folder is NotArchived here;
    ``already_moved`` settles it when the archive holds it."""
    return live.join(snapshot, key, "full").select(
        key,
        F.when(F.col("live_hash").isNull() | F.col("sha256").isNull(), "NotArchived")
        .when(F.col("live_hash").eqNullSafe(F.col("sha256")), "Archived")
        .otherwise("ChangedAfterRead").alias("archive_status"),
    )


def already_moved(status: DataFrame, archived: DataFrame, key: str = "file_job_id") -> DataFrame:
    """A move that happened before the status was written only needs the status."""
    found = archived.select(key).distinct().withColumn("_moved", F.lit(True))
    return (
        status.join(found, key, "left")
        .withColumn(
            "archive_status",
            F.when(F.col("_moved") & (F.col("archive_status") == "NotArchived"), "Archived").otherwise(F.col("archive_status")),
        )
        .drop("_moved")
    )


def archive_plan(jobs: DataFrame) -> DataFrame:
    """Target path of every file whose rows are all in Source; a failed import is not moved."""
    return jobs.filter(F.col("import_status").isin("Imported", "Duplicate")).withColumn(
        "archive_path", archive_path(F.col("config_id"), F.col("archived_on"), F.col("file_job_id"), F.col("file_name"))
    )


def move_files(plan: DataFrame, most: int = 10_000) -> DataFrame:
    """Carry out the moves of one batch: (path, archive_path, archive_status, reason).

    ``plan`` (path, archive_path) holds files whose bytes are unchanged. Repeated any number of times, also after a
    fault between a move and the record of it, it gives the same: a file that lies at its target and no longer at its
    source was moved before. Two files are never merged, and a place that is taken is a failure with its reason. A
    batch holds at most ``most`` files, as many as a poll admits."""
    spark = plan.sparkSession
    rows = plan.select("path", "archive_path").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} files in one batch of moves")
    out, systems = [], {}
    for path, target in rows:
        system, reason = re.match(r"([^/:]+:)?(//[^/]*)?", path).group(), None
        files = systems[system] = systems.get(system) or Files(spark, path)
        there, moved = files.exists(path), files.exists(target)
        if there and moved:
            reason = "TargetExists"
        elif there:
            try:
                files.move(path, target)
            except Exception as e:  # the next repetition tries again
                reason = f"{type(e).__name__}"
        elif not moved:
            reason = "SourceMissing"
        out.append((path, target, "ArchiveFailed" if reason else "Archived", reason))
    return spark.createDataFrame(out, MOVED)


def move_batches(plan: DataFrame, most: int = 10_000) -> DataFrame:
    """Carry out the moves of any number of files, as ``move_files`` in batches of at most ``most``, one after the other.

    The plan is written down first, so it stays what it was while files move, and numbered by a hash of its rows; the
    driver holds one batch. What a batch did is written down behind it. A run that breaks is repeated as a whole: files
    of the batches before the fault lie at their targets, which ``move_files`` tells from a place that is taken."""
    spark = plan.sparkSession
    rows = stage(plan.select("path", "archive_path").distinct(), "moves").withColumn("_hash", F.xxhash64("path", "archive_path"))
    numbered = number_rows(rows, [], ["_hash", "path", "archive_path"], F.shiftright("_hash", 52))
    dealt = stage(numbered.select("path", "archive_path", F.floor((F.col("row_number") - 1) / most).alias("batch")), "batches")
    batches = dealt.agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
    place = fresh_path(spark, "moved")
    spark.createDataFrame([], MOVED).write.parquet(place)  # there may be no batch
    for k in range(batches):
        move_files(dealt.where(F.col("batch") == k), most).write.mode("append").parquet(place)
    ends_with_session(spark, place)
    return spark.read.schema(MOVED).parquet(place)


def pending_finalization(jobs: DataFrame) -> DataFrame:
    """Mapped jobs that still owe an archive move or a notification, without mapping them again."""
    owes = present(
        [
            (F.col("archive_status").isin("NotArchived", "ArchiveFailed"), F.lit("archive")),
            (F.col("notification_status") != "Sent", F.lit("notification")),
        ]
    )
    return (
        jobs.filter(F.col("state").isin("Succeeded", "PartiallySucceeded"))
        .withColumn("action", F.explode(owes))
    )


def expired_artifacts(artifacts: DataFrame, asof, keep_days: int, rerun_days: int) -> DataFrame:
    """Artifacts past retention. Retention can not be shorter than the rerun window."""
    if keep_days < rerun_days:
        raise ValueError("retention is shorter than the rerun window")
    return artifacts.withColumn("age_days", F.date_diff(asof, F.to_date("stored_at"))).filter(F.col("age_days") > keep_days)
