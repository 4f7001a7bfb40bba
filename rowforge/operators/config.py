"""Table definitions, mapping configs and immutable versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions.convert import DATE_FORMAT_SHAPE, Field
from rowforge.functions.text import identifier_problem
from rowforge.operators.ordered import as_of, number_rows, with_next

FILE_TO_SOURCE = "array<struct<csvHeader:string,sourceColumn:string>>"
SOURCE_TO_NORMALIZED = "array<struct<sourceColumn:string,normalizedColumn:string,format:string>>"
DATA_TYPES = {"text": T.StringType(), "date": T.DateType(), "decimal": T.DecimalType(38, 10), "boolean": T.BooleanType()}
MAX_RULES = 1000


# ---- table definitions --------------------------------------------------


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    """(name, data type) pairs in ordinal order → schema; all data columns may be null."""
    return T.StructType([T.StructField(n, DATA_TYPES[t]) for n, t in columns])


def evolve(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Add the missing columns as null. Existing types never change and nothing is dropped."""
    have = dict(df.dtypes)
    for name, kind in columns:
        want = DATA_TYPES[kind].simpleString()
        if name in have and have[name] != want:
            raise ValueError(f"column {name} is {have[name]}, not {want}")
    return df.withColumns({n: F.lit(None).cast(DATA_TYPES[t]) for n, t in columns if n not in have})


def merge_columns(stored: DataFrame, defined: DataFrame) -> DataFrame:
    """(table_id, name, data_type, action, reason): what a new definition does to each stored column.

    Both sides hold (table_id, name, data_type). New columns are added, columns the definition no longer names are
    kept and stay null in new rows, a change of type is refused and the stored type holds."""
    both = stored.select("table_id", "name", F.col("data_type").alias("_stored")).join(
        defined.select("table_id", "name", F.col("data_type").alias("_defined")), ["table_id", "name"], "full"
    )
    known = F.col("_defined").isin(*DATA_TYPES)
    action = (
        F.when(F.col("_defined").isNull(), "Missing").when(~known, "Refused").when(F.col("_stored").isNull(), "Added")
        .when(F.col("_stored") != F.col("_defined"), "Refused").otherwise("Kept")
    )
    change = F.concat(F.lit("TypeChange:"), F.col("_stored"), F.lit(">"), F.col("_defined"))
    reason = F.when(~known, F.concat(F.lit("UnsupportedType:"), F.col("_defined"))).otherwise(change)
    merged = both.withColumn("action", action)
    return merged.select(
        "table_id", "name", F.coalesce("_stored", F.when(F.col("action") == "Added", F.col("_defined"))).alias("data_type"), "action",
        F.when(F.col("action") == "Refused", reason).alias("reason"),
    )


def validate_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_id, problem, detail) of every broken rule."""
    table_names = tables.select("table_id", identifier_problem(F.col("name")).alias("problem"), F.col("name").alias("detail"))
    column_names = columns.select("table_id", identifier_problem(F.col("name")).alias("problem"), F.col("name").alias("detail"))
    empty = tables.join(columns.select("table_id"), "table_id", "left_anti").select(
        "table_id", F.lit("NoColumns").alias("problem"), F.col("name").alias("detail")
    )
    twice = duplicate_rules(columns, ["table_id", "name"]).select(
        "table_id", F.lit("DuplicateColumn").alias("problem"), F.col("name").alias("detail")
    )
    source = columns.join(tables.filter(F.col("kind") == "Source").select("table_id"), "table_id", "left_semi")
    typed = source.select(
        "table_id", F.when(F.col("data_type") != "text", "SourceNotText").alias("problem"), F.col("name").alias("detail")
    )
    needed = source.select(
        "table_id", F.when(F.col("is_required"), "SourceRequired").alias("problem"), F.col("name").alias("detail")
    )
    out = table_names
    for part in (column_names, empty, twice, typed, needed):
        out = out.unionByName(part)
    return out.filter(F.col("problem").isNotNull()).distinct()


def duplicate_rules(rules: DataFrame, key: list[str]) -> DataFrame:
    return rules.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


# ---- versions -----------------------------------------------------------


def rules_json(kind: str, rules: Column) -> Column:
    return F.to_json(rules.cast(kind))


def parse_rules(versions: DataFrame) -> DataFrame:
    """JSON rule snapshots as arrays of structs."""
    return versions.withColumns(
        {
            "file_to_source": F.from_json("file_to_source", FILE_TO_SOURCE),
            "source_to_normalized": F.from_json("source_to_normalized", SOURCE_TO_NORMALIZED),
        }
    )


def file_rules(versions: DataFrame) -> DataFrame:
    return versions.select("version_id", F.inline("file_to_source")).select(
        "version_id", F.col("csvHeader").alias("csv_header"), F.col("sourceColumn").alias("source_column")
    )


def target_rules(versions: DataFrame) -> DataFrame:
    return versions.select("version_id", F.inline("source_to_normalized")).select(
        "version_id", F.col("sourceColumn").alias("source_column"),
        F.col("normalizedColumn").alias("normalized_column"), "format",
    )


def usable_format(fmt: Column) -> Column:
    return fmt.rlike(DATE_FORMAT_SHAPE) & fmt.contains("y") & fmt.contains("M") & fmt.contains("d")


def validate_versions(versions: DataFrame, columns: DataFrame) -> DataFrame:
    """(version_id, problem, detail). ``versions`` is parsed; ``columns`` are table_columns rows."""
    tables = versions.select("version_id", "source_table_id", "normalized_table_id")
    to_source, to_target = file_rules(versions), target_rules(versions)

    def unknown(rules: DataFrame, table: str, column: str, problem: str) -> DataFrame:
        known = columns.select(F.col("table_id").alias(table), F.col("name").alias(column))
        return (
            rules.join(tables, "version_id")
            .join(known, [table, column], "left_anti")
            .select("version_id", F.lit(problem).alias("problem"), F.col(column).alias("detail"))
        )

    source_names = to_source.select("version_id", "source_column").unionByName(to_target.select("version_id", "source_column"))
    # a version carries its rules and a table its columns as one short array each, so this
    # joins one row to one row and only missing columns become rows
    required = columns.filter("is_required").groupBy(F.col("table_id").alias("normalized_table_id")).agg(
        F.collect_set("name").alias("_required")
    )
    mapped = F.transform("source_to_normalized", lambda r: r["normalizedColumn"])
    unmapped = versions.join(required, "normalized_table_id").select(
        "version_id", F.lit("RequiredUnmapped").alias("problem"), F.explode(F.array_except("_required", mapped)).alias("detail")
    )
    dates = (
        to_target.filter(F.col("format").isNotNull())
        .join(tables, "version_id")
        .join(
            columns.filter(F.col("data_type") == "date").select(
                F.col("table_id").alias("normalized_table_id"), F.col("name").alias("normalized_column")
            ),
            ["normalized_table_id", "normalized_column"],
        )
        .filter(~usable_format(F.col("format")))
    )
    targets = columns.select(F.col("table_id").alias("normalized_table_id"), F.col("name").alias("normalized_column"), "data_type")
    unsupported = (
        to_target.join(tables, "version_id").join(targets, ["normalized_table_id", "normalized_column"])
        .filter(~F.coalesce(F.col("data_type").isin(*DATA_TYPES), F.lit(False)))
    )
    crowded = versions.filter(F.size("source_to_normalized") > MAX_RULES)
    parts = [
        unsupported.select("version_id", F.lit("UnsupportedType").alias("problem"), F.col("normalized_column").alias("detail")),
        crowded.select("version_id", F.lit("TooManyRules").alias("problem"), F.size("source_to_normalized").cast("string").alias("detail")),
        unknown(source_names, "source_table_id", "source_column", "UnknownSourceColumn"),
        unknown(to_target, "normalized_table_id", "normalized_column", "UnknownTargetColumn"),
        duplicate_rules(to_source, ["version_id", "csv_header"]).select(
            "version_id", F.lit("DuplicateCsvHeader").alias("problem"), F.col("csv_header").alias("detail")
        ),
        duplicate_rules(to_target, ["version_id", "normalized_column"]).select(
            "version_id", F.lit("DuplicateTarget").alias("problem"), F.col("normalized_column").alias("detail")
        ),
        unmapped,
        dates.select("version_id", F.lit("BadDateFormat").alias("problem"), F.col("format").alias("detail")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def attach_config(jobs: DataFrame, versions: DataFrame) -> DataFrame:
    """Rules of the version pinned on each job, as arrays, so a job stays one row."""
    return jobs.join(versions, "version_id", "left")


def fields_of(versions: DataFrame, columns: DataFrame, version_id: int) -> list[Field]:
    """Rules of one version compiled for ``normalize``. A version has one rule per target column.

    Column definitions may carry precision, scale and max_length; the defaults of ``Field`` hold where they don't."""
    sizes = [c for c in ("precision", "scale", "max_length") if c in columns.columns]
    rules = target_rules(versions.filter(F.col("version_id") == version_id))
    target = versions.filter(F.col("version_id") == version_id).select(F.col("normalized_table_id").alias("table_id"))
    defs = columns.join(target, "table_id", "left_semi")
    found = (
        rules.join(defs, rules.normalized_column == defs.name, "left")
        .orderBy("ordinal")
        .select("source_column", "normalized_column", "data_type", "is_required", "format", *sizes)
        .limit(MAX_RULES + 1)
        .collect()
    )
    if len(found) > MAX_RULES:
        raise ValueError(f"version {version_id} has more than {MAX_RULES} rules")
    unknown = [r.normalized_column for r in found if r.data_type is None]
    if unknown:
        raise ValueError(f"version {version_id} maps unknown columns {unknown}")
    return [
        Field(r.source_column, r.normalized_column, r.data_type, r.is_required, r.format, **{c: r[c] for c in sizes if r[c] is not None})
        for r in found
    ]


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("config_id").agg((F.max("version_no") + 1).alias("next_version"))


def number_versions(drafts: DataFrame, versions: DataFrame, order: list[str], span: Column) -> DataFrame:
    """Consecutive numbers for a batch of drafts after each config's highest version."""
    highest = versions.groupBy("config_id").agg(F.max("version_no").alias("_max"))
    return (
        number_rows(drafts, ["config_id"], order, span, out="_n")
        .join(highest, "config_id", "left")
        .withColumn("version_no", F.coalesce("_max", F.lit(0)) + F.col("_n"))
        .drop("_max", "_n")
    )


def activation_intervals(activations: DataFrame) -> DataFrame:
    """[activated_at, next activation) per config."""
    return with_next(activations, ["config_id"], "activated_at", "activated_at", out="active_until")


def pin_version(files: DataFrame, activations: DataFrame, at: str = "received_at") -> DataFrame:
    """The version active when each file arrived; later activations never change it."""
    return as_of(files, activations, ["config_id"], at, "activated_at", ["version_id"])
