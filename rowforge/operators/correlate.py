"""Confirm and cancel messages against their notice, and legal status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.operators.ordered import with_previous

# Allowed status changes per kind of object.
TRANSITIONS = {
    "import": (
        ("Queued", "Delaying"), ("Delaying", "Importing"), ("Importing", "Imported"), ("Importing", "ImportFailed"),
        ("Importing", "Duplicate"), ("ImportFailed", "Queued"),
    ),
    "archive": (
        ("NotArchived", "Archived"), ("NotArchived", "ArchiveFailed"), ("NotArchived", "ChangedAfterRead"),
        ("ArchiveFailed", "Archived"),
    ),
    "row": (("Pending", "Done"), ("Pending", "Invalid"), ("Pending", "Failed"), ("Failed", "Pending")),
    "job": (
        ("Queued", "Running"), ("Queued", "Cancelled"), ("Running", "RetryScheduled"), ("Running", "NeedsReview"),
        ("Running", "Succeeded"), ("Running", "PartiallySucceeded"), ("Running", "Failed"),
        ("Running", "CancelRequested"), ("RetryScheduled", "Queued"), ("CancelRequested", "Cancelled"),
        ("CancelRequested", "NeedsReview"),
    ),
    "header": (("I", "A"), ("I", "E")),
}


def correlate(notices: DataFrame, confirms: DataFrame, cancels: DataFrame, key: list[str], at: str) -> DataFrame:
    """Per business key: what arrived, in which order, and what is wrong with it.

    One partial aggregate over the three tagged inputs instead of two outer joins, so a
    key with very many messages is counted down before the shuffle."""
    tagged = None
    for kind, df in (("notice", notices), ("confirm", confirms), ("cancel", cancels)):
        part = df.select(*key, F.col(at).alias("_at"), F.lit(kind).alias("_kind"))
        tagged = part if tagged is None else tagged.unionByName(part)
    of = lambda kind: F.when(F.col("_kind") == kind, F.col("_at"))
    seen = tagged.groupBy(*key).agg(
        *[F.count(of(k)).alias(f"n_{k}") for k in ("notice", "confirm", "cancel")],
        *[F.min(of(k)).alias(f"first_{k}") for k in ("notice", "confirm", "cancel")],
    )
    n, c, x = F.col("n_notice"), F.col("n_confirm"), F.col("n_cancel")
    early = (F.col("first_confirm") < F.col("first_notice")) | (F.col("first_cancel") < F.col("first_notice"))
    return seen.withColumns(
        {
            "orphan": (n == 0) & (c + x > 0),
            "duplicate": (n > 1) | (c > 1) | (x > 1),
            "out_of_order": F.coalesce(early, F.lit(False)),
            "outcome": F.when(n == 0, "Orphan").when(x > 0, "Cancelled").when(c > 0, "Confirmed").otherwise("Open"),
        }
    )


def orphans(messages: DataFrame, notices: DataFrame, key: list[str]) -> DataFrame:
    """Single messages without a notice."""
    return messages.join(notices.select(*key), key, "left_anti")


def illegal_transitions(log: DataFrame, key: str, at: list[str], kind: str, span: Column) -> DataFrame:
    """Status changes that are not in the allowed list. The first status of an object has no predecessor."""
    allowed = [f"{a}>{b}" for a, b in TRANSITIONS[kind]]
    seen = with_previous(log, [key], at, ["status"], span)
    before = F.try_element_at("previous", F.lit(1))["status"]
    return (
        seen.withColumn("from_status", before)
        .filter(F.col("from_status").isNotNull() & ~F.concat_ws(">", "from_status", "status").isin(*allowed))
        .drop("previous")
    )
