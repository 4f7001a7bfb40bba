"""Comparison of results and revisions, and rerun lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.functions.arrays import present
from rowforge.session import stage


def diff_revisions(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rules added, removed or changed from ``a`` to ``b``."""
    cols = [c for c in a.columns if c not in key]
    left = a.select(*key, F.struct(*cols).alias("_a"))
    right = b.select(*key, F.struct(*cols).alias("_b"))
    return (
        left.join(right, key, "full")
        .withColumn(
            "change",
            F.when(F.col("_a").isNull(), "Added").when(F.col("_b").isNull(), "Removed")
            .when(~F.col("_a").eqNullSafe(F.col("_b")), "Changed"),
        )
        .filter(F.col("change").isNotNull())
        .select(*key, "change", *[F.col(f"_a.{c}").alias(f"old_{c}") for c in cols], *[F.col(f"_b.{c}").alias(f"new_{c}") for c in cols])
    )


def parity(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Cells that differ between two results, and rows only one side has."""
    cols = [c for c in a.columns if c not in key]
    text = lambda df, name: df.select(*key, F.struct(*[F.col(c).cast("string").alias(c) for c in cols]).alias(name))
    joined = text(a, "_a").join(text(b, "_b"), key, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    cells = present(
        [
            (F.col("_a").isNull(), _cell("(row)", F.lit("missing"), F.lit("present"))),
            (F.col("_b").isNull(), _cell("(row)", F.lit("present"), F.lit("missing"))),
            *[
                (both & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), _cell(c, F.col(f"_a.{c}"), F.col(f"_b.{c}")))
                for c in cols
            ],
        ]
    )
    return joined.select(*key, F.inline(cells))


def _cell(name, left, right):
    return F.struct(F.lit(name).alias("column"), left.alias("left_value"), right.alias("right_value"))


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, counting repeats."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def lineage(jobs: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Root and distance of every rerun. Each round doubles the known distance, so a chain
    of n reruns needs log2(n) joins; rounds are written out, so lost executors redo one round."""
    parent = F.coalesce("parent_job_id", "job_id")
    state = stage(
        jobs.select("job_id", parent.alias("anc"), F.col("parent_job_id").isNotNull().cast("bigint").alias("depth")), "lineage"
    )
    for _ in range(max_rounds):
        up = state.select(F.col("job_id").alias("anc"), F.col("anc").alias("_next"), F.col("depth").alias("_more"))
        state = stage(
            state.join(up, "anc").select("job_id", F.col("_next").alias("anc"), (F.col("depth") + F.col("_more")).alias("depth"), "_more"),
            "lineage",
        )
        if state.filter(F.col("_more") > 0).isEmpty():
            return state.select("job_id", F.col("anc").alias("root_job_id"), "depth")
        state = state.drop("_more")
    raise ValueError("parent links form a cycle")
