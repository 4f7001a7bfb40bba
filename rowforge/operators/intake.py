"""Files and rows on their way in: numbering, duplicates, readiness, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.operators.ordered import latest, with_previous
from rowforge.operators.skew import attach


# ---- row numbers --------------------------------------------------------


def with_row_number(landed: DataFrame, file_col: str, block: str = "_block", pos: str = "_pos") -> DataFrame:
    """Record ordinal from 1 per file, for rows that carry their split and position.

    Positions inside one split are consecutive, so a row's number is its distance
    from the split's first row plus the rows of the splits before it. Only one row per
    split is ever grouped by file; a file with a third of all rows stays spread out."""
    before = Window.partitionBy(file_col).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        landed.groupBy(file_col, block)
        .agg(F.min(pos).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(file_col, block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        landed.join(splits, [file_col, block])
        .withColumn("row_number", F.col(pos) - F.col("_first") + F.col("_offset") + 1)
        .drop(block, pos, "_first", "_offset")
    )


def total_rows(source: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows per file, known only once the file is imported."""
    counts = source.groupBy("file_job_id").agg(F.count(F.lit(1)).alias("n"))
    return jobs.join(counts, "file_job_id", "left").select(
        "file_job_id", "import_status",
        F.when(F.col("import_status") == "Imported", F.coalesce("n", F.lit(0))).alias("total_rows"),
    )


# ---- idempotent rows ----------------------------------------------------


def new_rows_only(df: DataFrame, source: DataFrame, key: tuple[str, ...] = ("file_job_id", "row_number")) -> DataFrame:
    """Rows not in the target yet. Two copies of a row in one batch count as one."""
    return df.join(source.select(*key), list(key), "left_anti").dropDuplicates(list(key))


# ---- duplicate files ----------------------------------------------------


def first_wins(files: DataFrame, key: list[str], order: list[str], id_col: str = "file_job_id") -> DataFrame:
    """Label every delivery ``First`` or ``Duplicate``; ``duplicate_of`` names the first.

    The winner per key comes from a partial aggregate and is joined back so that the
    copies of one content may be spread over tasks."""
    winners = files.groupBy(*key).agg(F.min_by(id_col, F.struct(*order)).alias("_winner"))
    return attach(files, winners, key, "inner").select(
        *files.columns,
        F.when(F.col(id_col) == F.col("_winner"), "First").otherwise("Duplicate").alias("delivery"),
        F.when(F.col(id_col) != F.col("_winner"), F.col("_winner")).alias("duplicate_of"),
    )


def mark_duplicates(new: DataFrame, registry: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Same content under the same config, in the batch or the registry.

    Registry rows that were duplicates themselves do not count."""
    known = (
        registry.filter(F.col("import_status") != "Duplicate")
        .groupBy(*key)
        .agg(F.min("file_job_id").alias("_known"))
    )
    return (
        attach(first_wins(new, key, order), known, key)
        .withColumn("duplicate_of", F.coalesce("_known", "duplicate_of"))
        .withColumn("import_status", F.when(F.col("duplicate_of").isNotNull(), "Duplicate").otherwise("Queued"))
        .drop("_known", "delivery")
    )


# ---- readiness and admission -------------------------------------------


def stable_files(observations: DataFrame, span: Column, n: int = 3) -> DataFrame:
    """First time a path was seen with the same size and mtime ``n`` times in a row."""
    seen = with_previous(observations, ["path"], ["observed_at"], ["size", "mtime"], span, depth=n - 1)
    same = F.forall("previous", lambda p: (p["size"] == F.col("size")) & (p["mtime"] == F.col("mtime")))
    return (
        seen.filter((F.size("previous") == n - 1) & same)
        .groupBy("path")
        .agg(F.min("observed_at").alias("ready_at"))
    )


def missed_files(listing: DataFrame, jobs: DataFrame) -> DataFrame:
    """Compensating scan: listed files whose current state has no job, skipping paths with an open job."""
    open_paths = jobs.filter(F.col("import_status").isin("Queued", "Delaying", "Importing")).select("path")
    return listing.join(jobs.select("intake_key"), "intake_key", "left_anti").join(open_paths, "path", "left_anti")


def quarantine(files: DataFrame, min_size: int = 1) -> DataFrame:
    """Files that cannot be read, with the reason. Expects size and header_cells."""
    why = (
        F.when(F.col("size") < min_size, "Empty")
        .when(F.col("header_cells").isNull() | (F.col("header_cells") < 2), "NoHeader")
    )
    return files.withColumn("reason", why).filter(F.col("reason").isNotNull())


def admit(waiting: DataFrame, n: int = 100, order: str = "id") -> DataFrame:
    """Oldest unsent first, at most ``n`` per poll (top-n: no full sort, no shuffle of all rows)."""
    return waiting.filter(F.col("sent_at").isNull()).orderBy(order).limit(n)


def fair_batch(jobs: DataFrame, k: int, asof: Column, aging_seconds: int) -> DataFrame:
    """At most ``k`` jobs per partner; waiting lifts a job's priority one level per ``aging_seconds``.

    The rank filter is pushed below the shuffle as a window group limit, so a partner
    with a huge queue sends only ``k`` rows per task."""
    waited = F.unix_micros(asof) - F.unix_micros(F.col("received_at"))
    aged = F.col("priority") - F.floor(waited / F.lit(aging_seconds * 1_000_000))
    order = Window.partitionBy("partner").orderBy("effective_priority", "received_at", "job_id")
    return (
        jobs.withColumn("effective_priority", aged.cast("bigint"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def release_after(held: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """Jobs whose hold, counted from when they were taken, is over."""
    return held.filter(F.col("taken_at") + F.make_dt_interval(secs=F.lit(seconds)) <= now)


def latest_file_state(events: DataFrame) -> DataFrame:
    """One row per intake key out of any number of events for it."""
    return latest(events, ["intake_key"], ["ts", "event_id"], oldest=True)
