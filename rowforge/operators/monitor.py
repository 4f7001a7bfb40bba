"""Operational reports: metrics, service levels, coverage, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.operators.ordered import percentiles


def ops_metrics(jobs: DataFrame, keys: list[str], asof: Column, width: float) -> DataFrame:
    """Jobs per state, oldest waiting age, p50/p95 of the processing time, suppressed duplicates."""
    counts = jobs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_jobs"),
        *[F.count_if(F.col("state") == s).alias(f"n_{s.lower()}") for s in ("Queued", "Running", "Succeeded", "Failed", "Duplicate")],
        F.min(F.when(F.col("state") == "Queued", F.col("received_at"))).alias("_oldest"),
    )
    spread = percentiles(
        jobs, keys, "processing_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, F.floor(F.col("processing_ms") / F.lit(width)).cast("bigint")
    )
    age = F.floor((F.unix_micros(asof) - F.unix_micros(F.col("_oldest"))) / 1_000_000)
    return counts.join(spread, keys, "left").withColumn("oldest_queue_s", age).drop("_oldest")


def slo_breach(jobs: DataFrame, key: str, at: str, window_s: int, baseline: DataFrame, width: float, factor: float = 1.2) -> DataFrame:
    """Windows whose p95 is above factor × baseline for the second time in a row.

    The lag runs over one row per key and window."""
    slot = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(window_s * 1_000_000)).alias("slot")
    p95 = percentiles(
        jobs.select(key, slot, "processing_ms"), [key, "slot"], "processing_ms", {"p95_ms": 0.95},
        F.floor(F.col("processing_ms") / F.lit(width)).cast("bigint"),
    )
    order = Window.partitionBy(key).orderBy("slot")
    over = p95.join(baseline, key).withColumn("_over", F.col("p95_ms") > F.col("baseline_ms") * factor)
    return (
        over.withColumn("_before", F.lag("_over").over(order))
        .filter(F.col("_over") & F.col("_before"))
        .drop("_over", "_before")
    )


def distinct_deliveries(df: DataFrame, keys: list[str], delivery: list[str]) -> DataFrame:
    return df.select(*keys, *delivery).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_deliveries"))


def coverage(runs: DataFrame) -> DataFrame:
    """Scenarios seen per partner and job type, and the partner's share of all runs."""
    per = runs.groupBy("partner", "job_type").agg(F.count(F.lit(1)).alias("n_runs"))
    return per.withColumn("share", F.col("n_runs") / per.agg(F.sum("n_runs")).scalar())


def search_jobs(jobs: DataFrame, partner=None, status=None) -> DataFrame:
    if partner is not None:
        jobs = jobs.filter(F.col("partner") == partner)
    if status is not None:
        jobs = jobs.filter(F.col("status") == status)
    return jobs
