"""Validation and conversion against other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.operators.skew import attach


def lookup(df: DataFrame, ref: DataFrame, on: list[str], mode: str = "attach") -> DataFrame:
    """attach: reference columns, null when missing; exists / missing: keep those rows.

    No hint: Catalyst broadcasts the reference when its size allows and shuffles otherwise."""
    how = {"attach": "left", "exists": "left_semi", "missing": "left_anti"}
    if mode not in how:
        raise ValueError(f"unknown lookup mode {mode!r}")
    return df.join(ref, on, how[mode])


def with_missing_flag(df: DataFrame, ref: DataFrame, on: str, ref_key: str, flag: str) -> DataFrame:
    """True where a non-null value has no match (null values are the required check's business)."""
    keys = ref.select(F.col(ref_key).alias(on)).distinct().withColumn("_found", F.lit(True))
    return (
        attach(df, keys, [on])
        .withColumn(flag, F.col(on).isNotNull() & F.col("_found").isNull())
        .drop("_found")
    )


def duplicate_keys(df: DataFrame, keys: list[str], target: DataFrame | None = None) -> DataFrame:
    """Keys that occur twice in the batch or already exist in the target."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_batch"))
    if target is None:
        return counts.filter(F.col("n_batch") > 1).withColumn("in_target", F.lit(False))
    stored = target.select(*keys).distinct().withColumn("_there", F.lit(True))
    return (
        counts.join(stored, keys, "left")
        .withColumn("in_target", F.coalesce("_there", F.lit(False)))
        .drop("_there")
        .filter((F.col("n_batch") > 1) | F.col("in_target"))
    )


def with_duplicate_flag(df: DataFrame, keys: list[str], flag: str, target: DataFrame | None = None) -> DataFrame:
    dup = duplicate_keys(df, keys, target).select(*keys, F.lit(True).alias("_dup"))
    return attach(df, dup, keys).withColumn(flag, F.coalesce("_dup", F.lit(False))).drop("_dup")
