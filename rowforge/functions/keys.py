"""Identity keys, hashes and computed paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUSINESS_ZONE = "Asia/Bangkok"
OPERATION_KEY = ("file_id", "sheet_id", "source_row_id", "target_id", "operation_type", "business_revision")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def intake_key(config_id: Column, path: Column, size: Column, modified: Column) -> Column:
    """One key per state of a file: the same path with new bytes gives a new job."""
    return F.concat_ws("|", config_id.cast("string"), path, size.cast("string"), modified.cast("string"))


def operation_key(*parts: Column) -> Column:
    """Same key over every attempt. Each part carries its length, so no two part lists run together."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *[F.concat_ws(":", F.length(t).cast("string"), t) for t in texts]), 256)


def archive_path(config_id: Column, day: Column, file_job_id: Column, file_name: Column) -> Column:
    return F.concat(
        F.lit("archive/"), config_id.cast("string"), F.lit("/"), F.date_format(day, "yyyyMMdd"), F.lit("/"),
        file_job_id.cast("string"), F.lit("_"), file_name,
    )


def business_date(ts: Column, zone: str = BUSINESS_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def archive_below_input(archive_root: str, input_root: str) -> bool:
    """An archive inside the watched folder would be read again."""
    a, i = archive_root.rstrip("/") + "/", input_root.rstrip("/") + "/"
    return a.startswith(i)
