"""File listing, snapshots and file-level checks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.functions.keys import intake_key
from rowforge.session import stage
from rowforge.sources import stored


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extensions(text: str) -> list[str]:
    """``csv|TXT,xls`` → [csv, txt, xls]."""
    return [e.strip().lstrip("*").lstrip(".").lower() for e in re.split(r"[|,]", text) if e.strip()]


def candidate(name: Column, size: Column, exts: str) -> Column:
    """A readable delivery: a wanted extension in any case, not temporary, not blank, not empty."""
    return (
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*extensions(exts))
        & ~name.contains("~$")
        & (F.trim(name) != "")
        & (size > 0)
    )


def list_candidates(spark: SparkSession, folder: str, exts: str = "csv") -> DataFrame:
    """Files of one folder, top level only; the bytes are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = file_name(F.col("path"))
    return (
        listing.select("path", name.alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        .filter(candidate(F.col("file_name"), F.col("size"), exts))
    )


def with_intake_key(listing: DataFrame, config_id: Column) -> DataFrame:
    return listing.withColumn(
        "intake_key", intake_key(config_id, F.col("path"), F.col("size"), F.unix_micros("mtime"))
    )


@dataclass(frozen=True)
class Snapshot:
    """Files as they were when read: their lines, what their splits do to quotes, and one row per file."""

    lines: DataFrame
    splits: DataFrame
    files: DataFrame

    def only(self, files: DataFrame) -> Snapshot:
        """The part of ``files`` (file)."""
        keep = lambda df, name="file": df.join(files.select(F.col("file").alias(name)).distinct(), name, "left_semi")
        return Snapshot(keep(self.lines), keep(self.splits), keep(self.files, "path"))


def listing(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, file_name, size, mtime); the bytes are not read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", file_name(F.col("path")).alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def with_hash(files: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    """``files`` (path) with the hash of their stored lines. Empty files are in no listing."""
    hashed = stored.hashes(lines).select(decoded_path(F.col("file")).alias("path"), F.col("sha256").alias(name))
    return files.join(hashed, "path", "left").withColumn(name, F.coalesce(name, F.sha2(F.lit(""), 256)))


def decoded_path(path: Column) -> Column:
    """Metadata columns escape a path, listings don't."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def stored_files(spark: SparkSession, paths: list[str] | str) -> Snapshot:
    """Lines of each file, stored once by many tasks a file; listing and hashes are made only where they are asked for."""
    lines = stored.store_lines(spark, paths)
    return Snapshot(lines, stored.splits(lines), with_hash(listing(spark, paths), lines, "sha256"))


def snapshot_files(spark: SparkSession, paths: list[str] | str) -> Snapshot:
    """``stored_files`` with the hash of each file stored too. Hashing, parsing and every retry use this copy."""
    found = stored_files(spark, paths)
    return Snapshot(found.lines, found.splits, stage(found.files, "snapshot"))


def live_hashes(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, live_hash) of the files as they are now."""
    return with_hash(listing(spark, paths), stored.raw_lines(spark, paths), "live_hash").select("path", "live_hash")
