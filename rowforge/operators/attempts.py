"""Attempt history, current results, status, retry and reprocess."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.operators.normalize import DONE, FAILED, INVALID, PENDING, row_errors
from rowforge.operators.ordered import latest, number_rows


def append_attempts(results: DataFrame, run_id: int, kind: str, version: Column) -> DataFrame:
    """Attempt rows of one run; written under their own run_id, so a rerun replaces only itself."""
    return results.select(
        F.lit(run_id).cast("bigint").alias("run_id"), "source_row_id", "file_job_id", "row_number",
        version.alias("config_version_id"), F.lit(kind).alias("kind"), "status",
    )


def upsert_normalized(current: DataFrame, new: DataFrame, key: str = "source_row_id", order: str = "run_id") -> DataFrame:
    """At most one row per source row; the highest run wins. ``new`` holds Done rows only."""
    return latest(current.unionByName(new), [key], [order])


def row_state(attempts: DataFrame) -> DataFrame:
    """Latest attempt beside the last successful one, in one aggregate."""
    done = F.when(F.col("status") == DONE, F.col("run_id"))
    return attempts.groupBy("source_row_id").agg(
        F.max_by("status", "run_id").alias("latest_status"),
        F.max_by("config_version_id", "run_id").alias("latest_version"),
        F.max(done).alias("current_run"),
        F.max_by("config_version_id", done).alias("current_version"),
        F.count(F.lit(1)).alias("n_attempts"),
    )


def row_history(attempts: DataFrame, span: Column) -> DataFrame:
    """Attempt number per source row in run order."""
    return number_rows(attempts, ["source_row_id"], ["run_id"], span, out="attempt_no")


def latest_attempts(attempts: DataFrame) -> DataFrame:
    return latest(attempts, ["source_row_id"], ["run_id"])


def file_counts(attempts: DataFrame) -> DataFrame:
    """Rows per status and file, by each row's latest attempt."""
    last = latest(attempts.select("source_row_id", "file_job_id", "run_id", "status"), ["source_row_id"], ["run_id"])
    return last.groupBy("file_job_id").agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in (PENDING, DONE, INVALID, FAILED)]
    )


def normalization_status(import_status: Column) -> Column:
    return (
        F.when((import_status != "Imported") | (F.col("pending") > 0), "InProgress")
        .when((F.col("invalid") > 0) | (F.col("failed") > 0), "CompletedWithErrors")
        .otherwise("Completed")
    )


def file_status(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("pending", "done", "invalid", "failed")]
    return jobs.join(counts, "file_job_id", "left").select(*jobs.columns, *filled).withColumn(
        "normalization_status", normalization_status(F.col("import_status"))
    )


def file_errors(row_results: DataFrame) -> DataFrame:
    """Errors of each row's latest run, ordered for reading. The errors travel with the
    results, so one aggregate finds the latest run and its errors together."""
    keep = ("source_row_id", "file_job_id", "row_number", "run_id")
    last = latest(row_results.select(*keep, "status", "errors"), ["source_row_id"], ["run_id"])
    return row_errors(last, keep).orderBy("file_job_id", "row_number", "field")


def page(df: DataFrame, order: list[str], after: list | None, n: int) -> DataFrame:
    """Keyset page: the filter reaches the scan and only n rows per task are sorted out."""
    if after is not None:
        clauses = []
        for i, (c, v) in enumerate(zip(order, after)):
            same = reduce(lambda a, b: a & b, [F.col(x) == y for x, y in zip(order[:i], after[:i])], F.lit(True))
            clauses.append(same & (F.col(c) > v))
        df = df.filter(reduce(lambda a, b: a | b, clauses))
    return df.orderBy(*order).limit(n)


# ---- retry and reprocess ------------------------------------------------


def eligible_for_retry(df: DataFrame, allowed: str) -> DataFrame:
    """File retries need ``ImportFailed``, row retries ``Failed``; others are refused with the reason."""
    return df.withColumn("accepted", F.col("status") == allowed).withColumn(
        "refusal", F.when(F.col("status") != allowed, F.concat(F.lit("NotRetryable:"), F.col("status")))
    )


def retry_rows(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """Failed attempts take the new result under the same run and version; all others stay."""
    fresh = results.select("source_row_id", F.col("status").alias("_new"))
    latest_failed = latest_attempts(attempts).filter(F.col("status") == FAILED).select("source_row_id", "run_id")
    retried = latest_failed.join(fresh, "source_row_id")
    return (
        attempts.join(retried, ["source_row_id", "run_id"], "left")
        .withColumn("status", F.coalesce("_new", "status"))
        .select(*attempts.columns)
    )


def retry_failed(attempts: DataFrame, source: DataFrame, convert: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(source_row_id, run_id, file_job_id, before, after) of every row whose latest attempt failed; only those are converted."""
    failed = latest_attempts(attempts).filter(F.col("status") == FAILED).select("source_row_id", "run_id", "file_job_id")
    fresh = convert(source.join(failed.select("source_row_id"), "source_row_id", "left_semi")).select("source_row_id", F.col("status").alias("after"))
    return failed.withColumn("before", F.lit(FAILED)).join(fresh, "source_row_id")


def recount(counts: DataFrame, changed: DataFrame) -> DataFrame:
    """File counts after ``changed`` (file_job_id, before, after): a sum per touched file, no other row is read."""
    states = (PENDING, DONE, INVALID, FAILED)
    moved = lambda s: F.count_if(F.col("after") == s) - F.count_if(F.col("before") == s)
    delta = changed.groupBy("file_job_id").agg(*[moved(s).alias(f"_{s.lower()}") for s in states])
    names = [s.lower() for s in states]
    return counts.join(delta, "file_job_id", "left").select(
        "file_job_id", *[(F.coalesce(n, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names]
    )


def select_rows(source: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Whole file, or the chosen (file_job_id, row_number) pairs."""
    return source if rows is None else source.join(rows, ["file_job_id", "row_number"], "left_semi")


def overlap_conflicts(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Requested rows that still have a pending attempt."""
    pending = attempts.filter(F.col("status") == PENDING).select("source_row_id")
    return requests.join(pending, "source_row_id", "left_semi")


def without_overlap(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    pending = attempts.filter(F.col("status") == PENDING).select("source_row_id")
    return requests.join(pending, "source_row_id", "left_anti")


def source_for_reprocess(source: DataFrame, source_columns: list[str], file_job_id: int | None = None) -> DataFrame:
    """Stored Source rows for a new version; refuses a version that needs columns Source lacks."""
    missing = sorted(set(source_columns) - set(source.columns))
    if missing:
        raise ValueError(f"source lacks columns {missing}")
    return source if file_job_id is None else source.filter(F.col("file_job_id") == file_job_id)
