"""Operations against the ledger of what is committed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.keys import OPERATION_KEY, operation_key


def with_operation_key(ops: DataFrame) -> DataFrame:
    return ops.withColumn("operation_key", operation_key(*[F.col(c) for c in OPERATION_KEY]))


def _key_columns(ledger: DataFrame) -> tuple[str, ...]:
    """The columns a ledger names an operation by; one that holds digests alone is met by digest."""
    return OPERATION_KEY if set(OPERATION_KEY) <= set(ledger.columns) else ("operation_key",)


def _same_operation(ops: DataFrame, ledger: DataFrame, keys: tuple[str, ...]) -> Column:
    """The key columns of both sides agree; missing parts agree with missing parts. No digest is shuffled."""
    same = [ops[c].eqNullSafe(ledger[f"_{c}"]) for c in keys]
    return reduce(lambda x, y: x & y, same)


def uncommitted(ops: DataFrame, ledger: DataFrame) -> DataFrame:
    """Operations not in the ledger, by the columns of their key. Keys stay the same over attempts, so nothing runs twice."""
    keys = _key_columns(ledger)
    committed = ledger.filter(F.col("committed_at").isNotNull()).select(*[F.col(c).alias(f"_{c}") for c in keys])
    return ops.join(committed, _same_operation(ops, committed, keys), "left_anti")


def resume_failed(ops: DataFrame, ledger: DataFrame) -> DataFrame:
    return with_operation_key(uncommitted(ops, ledger).dropDuplicates(list(OPERATION_KEY)))


def classify_recovery(ops: DataFrame, ledger: DataFrame) -> DataFrame:
    """Where a crash left each operation, and what may follow."""
    keys = _key_columns(ledger)
    found = ledger.select(*[F.col(c).alias(f"_{c}") for c in keys], "committed_at", "affected_rows", F.lit(True).alias("_in_ledger"))
    plan = ops.select(*keys, "expected_rows", F.lit(True).alias("_planned"))
    joined = plan.join(found, _same_operation(plan, found, keys), "full").withColumns({c: F.coalesce(c, f"_{c}") for c in keys})
    point = (
        F.when(F.col("_planned").isNull(), "Unknown").when(F.col("_in_ledger").isNull(), "NotStarted")
        .when(F.col("committed_at").isNull(), "Unknown")
        .when(F.col("affected_rows") < F.col("expected_rows"), "Partial").otherwise("Committed")
    )
    told = joined.withColumn("crash_point", point)
    return (with_operation_key(told) if keys == OPERATION_KEY else told).select("operation_key", "crash_point").withColumn(
        "action",
        F.when(F.col("crash_point") == "NotStarted", "Retry").when(F.col("crash_point") == "Committed", "Skip")
        .when(F.col("crash_point") == "Partial", "ResumeRest").otherwise("Review"),
    )


def idempotency_check(requests: DataFrame, scope: list[str], key: str, payload_hash: Column) -> DataFrame:
    """Same scope, key and payload: one request. Another payload under the key: conflict.

    Smallest and largest hash tell whether there is more than one; no set is built."""
    return (
        requests.withColumn("_hash", payload_hash)
        .groupBy(*scope, key)
        .agg(F.count(F.lit(1)).alias("n_requests"), (F.min("_hash") != F.max("_hash")).alias("_differ"))
        .withColumn("verdict", F.when(F.col("_differ"), "Conflict").when(F.col("n_requests") > 1, "Repeated").otherwise("New"))
        .drop("_differ")
    )
