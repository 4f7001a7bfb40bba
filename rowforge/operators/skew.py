"""Joining rows to facts that were aggregated by the same key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``facts``, which holds one row per key.

    AQE splits a hot key only when both join inputs come straight from a shuffle. An
    aggregate already partitioned by the key is not shuffled again, so joining it by name
    would leave every row of a hot key in one task. Joined by a struct of the keys, the
    small aggregate takes one more shuffle and the hot rows are spread."""
    left = rows.withColumn("_key", F.struct(*keys))
    right = facts.withColumn("_fact_key", F.struct(*keys)).drop(*keys)
    return left.join(right, F.col("_key") == F.col("_fact_key"), how).drop("_key", "_fact_key")
