"""File record → Source row → typed result, all as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions import convert as C
from rowforge.functions.arrays import settled
from rowforge.functions.text import trimmed

LINEAGE = ("source_row_id", "file_job_id", "row_number")
DONE, INVALID, FAILED, PENDING = "Done", "Invalid", "Failed", "Pending"


def project_to_source(df: DataFrame, rules: list[tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename file headers to source columns; every field stays text."""
    return df.select(*keep, *[F.col(f"`{h}`").cast("string").alias(s) for h, s in rules])


def with_lineage(df: DataFrame, file_job_id: Column, imported_at: Column) -> DataFrame:
    return df.withColumns({"file_job_id": file_job_id, "imported_at": imported_at})


def with_staging_columns(df: DataFrame, file: Column, day: Column, trans_id: Column) -> DataFrame:
    """Lineage of the older staging tables: file, create date, open flag, transaction."""
    return df.withColumns(
        {"file": file, "create_date": F.date_format(day, "yyyyMMdd"), "stat_flag": F.lit("I"), "trans_id": trans_id}
    )


def normalize(df: DataFrame, fields: list[C.Field], keep: tuple[str, ...] = LINEAGE) -> DataFrame:
    """Typed columns, ``errors`` with every failing field, and ``status``.

    Stacked projections: trim, convert, judge, collect. Each text is trimmed and parsed
    once, also when the result is filtered by status afterwards."""
    names = [f.target for f in fields]
    texts = df.select(*keep, *[trimmed(F.col(f.source)).alias(f"_raw_{f.target}") for f in fields])
    valued = texts.select("*", *[C.converted(F.col(f"_raw_{f.target}"), f).alias(f.target) for f in fields])
    judged = valued.select(
        *keep, *names, *[C.reason(F.col(f"_raw_{f.target}"), F.col(f.target), f).alias(f"_why_{f.target}") for f in fields]
    )
    why = {n: F.col(f"_why_{n}") for n in names}
    status = F.when(F.coalesce(*why.values()).isNull(), DONE).otherwise(INVALID)
    return settled(
        judged, keep, [*[F.col(n) for n in names], C.all_errors(list(why.items())).alias("errors"), status.alias("status")]
    )


def valid_rows(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == DONE).drop("errors", "status")


def row_errors(results: DataFrame, keep: tuple[str, ...] = LINEAGE) -> DataFrame:
    """One row per failing field."""
    return (
        results.filter(F.col("status") == INVALID)
        .select(*keep, F.explode("errors").alias("e"))
        .select(*keep, "e.field", "e.reason")
    )


def preview(df: DataFrame, fields: list[C.Field], n: int, order: list[str], keep: tuple[str, ...] = LINEAGE) -> DataFrame:
    """First ``n`` rows with the text before and the value after each rule; writes nothing."""
    if any(f.source == f.target for f in fields):
        raise ValueError("preview needs source and target names that differ")
    sample = df.orderBy(*order).limit(n)
    result = normalize(sample, fields, keep + tuple(dict.fromkeys(f.source for f in fields)))
    cells = F.array(
        *[
            F.struct(
                F.lit(f.target).alias("field"), F.col(f.source).alias("before"),
                F.col(f.target).cast("string").alias("after"),
            )
            for f in fields
        ]
    )
    reasons = F.map_from_entries("errors")
    return result.select(*keep, "status", F.explode(cells).alias("c"), reasons.alias("_r")).select(
        *keep, "status", "c.field", "c.before", "c.after", F.try_element_at("_r", F.col("c.field")).alias("reason")
    )
