"""Staging rows to several targets, their operations, header state and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.arrays import present, settled
from rowforge.functions.rules import (
    ColumnMap, Predicate, TargetMap, all_of, column_expr, conversion_failed, typed_sources, typed_value,
)
from rowforge.functions.text import with_trimmed
from rowforge.operators.ordered import latest

SUCCEEDED, FAILED, UNKNOWN = "Succeeded", "Failed", "Unknown"
PRIMARY, UNION = "PRIMARY", "UNION"
# Job steps the two restricted partners may run.
RESTRICTED_MODES = ("AY", "TQM")
RESTRICTED_STEPS = tuple(f"{i:02d}" for i in (*range(1, 11), *range(51, 56)))


# ---- selection ----------------------------------------------------------


def active_jobs(config: DataFrame, mode: str, group: str = "MAPOR") -> DataFrame:
    """Active jobs of a partner; two partners are held to a fixed set of steps."""
    jobs = config.filter((F.col("grp") == group) & (F.col("stat_flag") == "A") & (F.col("desc1") == mode.upper()))
    return jobs.filter(F.col("desc5").isin(*RESTRICTED_STEPS)) if mode.upper() in RESTRICTED_MODES else jobs


def pending_headers(headers: DataFrame, mode: str) -> DataFrame:
    """Open headers of a partner (the AY partner only its AY-0 jobs)."""
    part = "AY-0" if mode.upper() == "AY" else f"{mode}-"
    return headers.filter((F.col("stat_flag") == "I") & F.col("system_id").contains(part))


def row_selection(rows: DataFrame, trans: DataFrame, predicates: list[Predicate]) -> DataFrame:
    """Rows of the given transactions that meet the configured predicates. A predicate on
    row_number replaces the others, as the first ROWNUM rule does."""
    by_number = [p for p in predicates if p.column == "row_number"][:1]
    return rows.filter(all_of(by_number or predicates)).join(trans.select("trans_id"), "trans_id", "left_semi")


def first_condition(conditions: DataFrame) -> DataFrame:
    """The condition with the lowest sequence per target column."""
    return latest(conditions, ["map_id", "target_column"], ["sequence"], oldest=True)


def resolve_headers(deliveries: DataFrame, headers: DataFrame) -> DataFrame:
    """Reuse the header of the same (system, file, sheet); a new one gets an id made from its key."""
    key = ["system_id", "ref_no", "sub_ref_no"]
    known = headers.groupBy(*key).agg(F.min("trans_id").alias("_known"))
    parts = [F.concat_ws(":", F.length(F.col(c).cast("string")).cast("string"), F.col(c).cast("string")) for c in key]
    return (
        deliveries.select(*key)
        .distinct()
        .join(known, key, "left")
        .select(
            *key, F.coalesce("_known", F.sha2(F.concat_ws("|", *parts), 256)).alias("trans_id"),
            F.col("_known").isNull().alias("is_new"),
        )
    )


# ---- fan-out ------------------------------------------------------------


def target_rows(df: DataFrame, target: TargetMap, keep: tuple[str, ...]) -> DataFrame:
    """Rows of one target that pass its filter and convert completely.

    Trim, convert, judge: three projections, so each field is worked on once."""
    typed = [m for m in plain_columns(target) if m.source is not None and m.type != "STRING"]
    value = {m.target: F.col(f"_v_{m.target}") for m in typed}
    valued = with_trimmed(df.filter(all_of(target.where)), typed_sources(tuple(typed))).select(
        "*", *[typed_value(m).alias(f"_v_{m.target}") for m in typed]
    )
    failed = [conversion_failed(m, value[m.target]) for m in typed]
    judged = valued.select(
        *keep, *[column_expr(m, target.conditions, value.get(m.target)) for m in target.columns],
        reduce(lambda a, b: a | b, failed, F.lit(False)).alias("_failed"),
    )
    return settled(judged, keep, [F.col(c) for c in judged.columns if c not in keep]).filter(~F.col("_failed")).drop("_failed")


def plain_columns(target: TargetMap) -> list[ColumnMap]:
    """Columns mapped directly, not through a condition."""
    special = {c.target for c in target.conditions}
    return [m for m in target.columns if m.target not in special]


def target_failed(target: TargetMap) -> Column:
    """True when any directly mapped column has text that does not convert."""
    return reduce(lambda a, b: a | b, [conversion_failed(m) for m in plain_columns(target)], F.lit(False))


def fan_out(df: DataFrame, targets: list[TargetMap], keep: tuple[str, ...]) -> dict[str, DataFrame]:
    """One DataFrame per target, in sequence order."""
    return {t.target_id: target_rows(df, t, keep) for t in sorted(targets, key=lambda t: t.sequence)}


def operations(df: DataFrame, targets: list[TargetMap], keep: tuple[str, ...], operation_type: str = PRIMARY) -> DataFrame:
    """One operation per row and target with its own result. All targets are judged in
    one pass over the rows, not one pass each."""
    ordered = sorted(targets, key=lambda t: t.sequence)
    flags = [
        c for i, t in enumerate(ordered)
        for c in (all_of(t.where).alias(f"_wanted_{i}"), target_failed(t).alias(f"_failed_{i}"))
    ]
    judged = [
        (
            F.col(f"_wanted_{i}"),
            F.struct(
                F.lit(t.target_id).alias("target_id"), F.lit(t.sequence).alias("sequence"),
                F.lit(operation_type).alias("operation_type"),
                F.when(F.col(f"_failed_{i}"), FAILED).otherwise(SUCCEEDED).alias("result"),
            ),
        )
        for i, t in enumerate(ordered)
    ]
    sources = [s for t in ordered for s in typed_sources(tuple(plain_columns(t)))]
    return with_trimmed(df, sources).select(*keep, *flags).select(*keep, F.inline(present(judged)))


def with_union(df: DataFrame, primary: TargetMap, union: TargetMap, keep: tuple[str, ...]) -> DataFrame:
    """A second mapping of the same row is a second operation with its own result."""
    return operations(df, [primary], keep, PRIMARY).unionByName(operations(df, [union], keep, UNION))


# ---- results ------------------------------------------------------------


def job_counts(ops: DataFrame, job: str, row: list[str]) -> DataFrame:
    """Rows and operations per job; a row is complete when all its operations succeeded."""
    ok, bad = F.col("result") == SUCCEEDED, F.col("result") == FAILED
    rows = ops.groupBy(job, *row).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(ok).alias("_ok"), F.count_if(bad).alias("_bad"),
        F.sum("affected_rows").alias("_written"),
    )
    return rows.groupBy(job).agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(F.col("_ok") == F.col("_n")).alias("completed_rows"),
        F.count_if(F.col("_bad") > 0).alias("failed_rows"), F.sum("_n").alias("expected_operations"),
        F.sum("_ok").alias("succeeded_operations"), F.sum("_bad").alias("failed_operations"),
        F.sum("_written").alias("rows_written"),
    )


def job_state(ops: DataFrame, job: str) -> DataFrame:
    """State from required operations; any unclear outcome stops for review. Nothing required is nothing failed."""
    needed = F.coalesce(F.col("required"), F.lit(False))
    ok = F.when(needed, F.coalesce(F.col("result") == SUCCEEDED, F.lit(False)))
    unclear = F.when(needed, F.coalesce(F.col("result") == UNKNOWN, F.lit(True)))
    return ops.groupBy(job).agg(
        F.when(F.bool_or(unclear), "NeedsReview")
        .when(F.coalesce(F.bool_and(ok), F.lit(True)), "Succeeded").when(F.bool_or(ok), "PartiallySucceeded").otherwise("Failed").alias("state")
    )


def close_headers(headers: DataFrame, ops: DataFrame, selected: DataFrame) -> DataFrame:
    """Open headers become A or E once every target that selected rows of them has reported on all; closed ones never change.

    ``ops`` has trans_id, target_id and result; ``selected`` has trans_id, target_id and n_rows. A header
    that no target selected rows of has nothing to wait for and closes as A once it has rows at all (n_rows 0)."""
    per_target = ops.groupBy("trans_id", "target_id").agg(F.count(F.lit(1)).alias("_done"), F.bool_and(F.col("result") == SUCCEEDED).alias("_ok"))
    due = selected.join(per_target, ["trans_id", "target_id"], "left")
    done = due.groupBy("trans_id").agg(
        F.bool_and(F.coalesce(F.col("_done"), F.lit(0)) >= F.col("n_rows")).alias("_seen"), F.bool_and(F.coalesce(F.col("_ok"), F.lit(True))).alias("_all_ok")
    )
    closing = (F.col("stat_flag") == "I") & F.coalesce(F.col("_seen"), F.lit(False))
    return (
        headers.join(done, "trans_id", "left")
        .withColumn("stat_flag", F.when(closing, F.when(F.col("_all_ok"), "A").otherwise("E")).otherwise(F.col("stat_flag")))
        .drop("_seen", "_all_ok")
    )


def selected_rows(df: DataFrame, targets: list[TargetMap], trans: str = "trans_id") -> DataFrame:
    """(trans_id, target_id, n_rows): rows of each transaction that each target selects, zero included."""
    counts = df.groupBy(F.col(trans).alias("trans_id")).agg(*[F.count_if(all_of(t.where)).alias(f"_n_{i}") for i, t in enumerate(targets)])
    rows = F.array(*[F.struct(F.lit(t.target_id).alias("target_id"), F.col(f"_n_{i}").alias("n_rows")) for i, t in enumerate(targets)])
    return counts.select("trans_id", F.inline(rows))


def reconcile(results: DataFrame, keys: list[str]) -> DataFrame:
    """Steps 1 source, 2 success, 3 error per key, as rows."""
    counts = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "Done").alias("ok"),
        F.count_if(F.col("status") != "Done").alias("bad"),
    )
    step = lambda no, src, dst, err, flag: F.struct(
        F.lit(no).alias("step_no"), src.alias("count_source"), dst.alias("count_destination"),
        err.alias("count_error"), flag.alias("status_flag"),
    )
    none = F.lit(None).cast("bigint")
    steps = F.array(
        step(1, F.col("n"), none, none, F.lit("A")), step(2, none, F.col("ok"), none, F.lit("A")),
        step(3, none, none, F.col("bad"), F.when(F.col("bad") > 0, "E").otherwise("A")),
    )
    return counts.select(*keys, F.inline(steps))


def reconcile_log(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by the full key, error steps included."""
    marked = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(marked, [*keys, "step_no"], ["_new"]).drop("_new")


def error_summary(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Errors per field and reason with the number of rows they touch."""
    return errors.groupBy(*keys, "field", "reason").agg(
        F.count(F.lit(1)).alias("n_errors"), F.min("row_number").alias("first_row")
    )


def notification_summary(violations: DataFrame, totals: DataFrame, header: str) -> DataFrame:
    """One row per header: both error counts and the kinds of partner error.

    Details stay rows in the violations table; only the kinds, few by construction,
    are listed here. Subject is SUCCESS only without any error."""
    kinds = violations.groupBy(header, "category", "field", "reason").agg(F.count(F.lit(1)).alias("n"))
    partner = F.col("category") == "partner"
    errors = kinds.groupBy(header).agg(
        F.coalesce(F.sum(F.when(partner, F.col("n"))), F.lit(0)).alias("partner_errors"),
        F.coalesce(F.sum(F.when(~partner, F.col("n"))), F.lit(0)).alias("system_errors"),
        F.array_sort(F.collect_list(F.when(partner, F.concat_ws(":", "field", "reason", F.col("n").cast("string"))))).alias("_kinds"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return totals.join(errors, header, "left").select(
        *totals.columns, zero("partner_errors"), zero("system_errors"),
        F.coalesce(F.array_join("_kinds", "; "), F.lit("")).alias("partner_detail"),
        F.when(F.coalesce("partner_errors", F.lit(0)) + F.coalesce("system_errors", F.lit(0)) == 0, "SUCCESS")
        .otherwise("ERROR").alias("subject"),
    )


def collisions(rows: DataFrame) -> DataFrame:
    """Row numbers used by more than one transaction of a shared staging table."""
    return (
        rows.select("row_number", "trans_id").distinct()
        .groupBy("row_number").agg(F.count(F.lit(1)).alias("n_trans"))
        .filter(F.col("n_trans") > 1)
    )
