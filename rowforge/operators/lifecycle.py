"""Import retry: the same bytes, the same version, only the rows still missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.operators.intake import new_rows_only
from rowforge.sources import csv as S
from rowforge.sources import stored
from rowforge.sources.files import Snapshot, decoded_path


def _rehashed(snapshot: Snapshot) -> DataFrame:
    """(path, file, same): whether the stored lines still give the hash stored with them."""
    now = stored.hashes(snapshot.lines).select("file", decoded_path(F.col("file")).alias("path"), F.col("sha256").alias("_now"))
    return snapshot.files.join(now, "path").select("path", "file", (F.col("_now") == F.col("sha256")).alias("same"))


def changed_snapshots(snapshot: Snapshot) -> DataFrame:
    """Snapshots whose bytes no longer give the hash stored with them."""
    return _rehashed(snapshot).filter(~F.col("same")).select("path")


def retry_import(snapshot: Snapshot, source: DataFrame, rules: list[tuple[str, str]], width: int | None = None) -> DataFrame:
    """Source rows a broken import left out, numbered as in the first try.

    Rows come from the stored lines whose hash still holds, so a changed file can not mix
    into an import that began with the old one."""
    landed = S.parse(snapshot.only(_rehashed(snapshot).filter("same")), width)
    records = S.records(landed, S.headers(landed), rules)
    return new_rows_only(records, source, ("file", "row_number"))
