"""Export, merge, enrichment and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.operators.ordered import latest
from rowforge.operators.skew import attach
from rowforge.sources.lines import value_columns


# ---- selection ----------------------------------------------------------


def open_headers(headers: DataFrame, system_id: str) -> DataFrame:
    return headers.filter((F.col("system_id") == system_id) & (F.coalesce("exp_flag", F.lit("N")) == "N"))


def not_exported(headers: DataFrame, system_id: str) -> DataFrame:
    """Distinct transactions of a system whose export flag is not set."""
    return open_headers(headers, system_id).select("trans_id").distinct()


def join_details(headers: DataFrame, details: DataFrame) -> DataFrame:
    return headers.join(details, "trans_id")


def export_selection(headers: DataFrame, details: DataFrame, system_id: str, condition: Column) -> DataFrame:
    """Header → file name → detail. The detail filter reaches the scan before the join."""
    wanted = open_headers(headers, system_id).select("trans_id", "ref_no").distinct()
    return attach(details.filter(condition), wanted, ["trans_id"], "inner")


def mark_exported(headers: DataFrame, published: DataFrame) -> DataFrame:
    """Flag Y for transactions whose file is published; runs after the publish and can be repeated."""
    done = published.select("trans_id").distinct().withColumn("_done", F.lit(True))
    return (
        headers.join(done, "trans_id", "left")
        .withColumn("exp_flag", F.when(F.col("_done"), "Y").otherwise(F.col("exp_flag")))
        .drop("_done")
    )


def export_columns(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Configured columns under their heading, in order."""
    return df.select(*[F.col(c).alias(heading) for c, heading in columns])


# ---- enrichment ---------------------------------------------------------


def current_year(df: DataFrame, date_col: str, asof: Column) -> DataFrame:
    """Rows of the year of ``asof``, as a range that reaches the scan."""
    start = F.make_date(F.year(asof), F.lit(1), F.lit(1))
    return df.filter((F.col(date_col) >= start) & (F.col(date_col) < F.add_months(start, 12)))


def enrich_policy(df: DataFrame, policy: DataFrame, motor: DataFrame, asof: Column) -> DataFrame:
    """Newest policy of this year by (chassis, agent), with its motor detail.

    The detail is joined to the policies, so rows without a policy never meet it. Rows without a whole key can
    match nothing and go around the join."""
    this_year = latest(current_year(policy, "cc_date", asof), ["chassis", "agent"], ["cc_date", "policy_no"])
    facts = this_year.where("chassis IS NOT NULL AND agent IS NOT NULL").join(motor, "policy_no", "left")
    whole = F.col("chassis").isNotNull() & F.col("agent").isNotNull()
    found = attach(df.where(whole), facts, ["chassis", "agent"])
    bare = df.where(~whole).withColumns({f.name: F.lit(None).cast(f.dataType) for f in facts.schema if f.name not in df.columns})
    return found.unionByName(bare.select(*found.columns)).select("policy_no", *[c for c in found.columns if c != "policy_no"])


def fill_enriched(df: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    return df.withColumns(
        {**{c: F.coalesce(c, F.lit("")) for c in texts}, **{c: F.coalesce(c, F.lit(0)) for c in numbers}}
    )


# ---- merge --------------------------------------------------------------


def only_sheet(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("sheet") == name)


def merge_files(files: list[DataFrame], sheet: str) -> DataFrame:
    """Rows of one sheet out of many files as one dataset."""
    return reduce(DataFrame.unionByName, [only_sheet(f, sheet) for f in files])


def merge_output(df: DataFrame, n: int = 23, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *value_columns([c for c in df.columns if c not in keep], n))


def merge_name(day: Column) -> Column:
    return F.concat(F.lit("MergeFiles_"), F.date_format(day, "yyyyMMdd"))


# ---- manifests ----------------------------------------------------------


def missing_from_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files.select(F.col("file_name").alias("expected_file")), "expected_file", "left_anti")


def manifest_ready(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per manifest: expected, present, and whether the set is complete."""
    present = files.select(F.col("file_name").alias("expected_file")).distinct().withColumn("_here", F.lit(1))
    return (
        manifest.join(present, "expected_file", "left")
        .groupBy("manifest_id")
        .agg(F.count(F.lit(1)).alias("expected"), F.count("_here").alias("present"))
        .withColumn("ready", F.col("expected") == F.col("present"))
    )
