"""Queries: definitions, versions and pinning. Definitions are derived from part, activations from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.operators import config as G
from rowforge.operators.ordered import id_range
from rowforge.plans.catalog import Tables, query

# ---- definitions: a brand is a table, its parts are columns ---------------

DEFS = """
tables AS (SELECT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS table_id,
    CASE WHEN CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 9 = 0 THEN p_brand
         WHEN CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 8 = 0 THEN 'pg_' || lower(replace(p_brand, '#', '_'))
         ELSE lower(replace(p_brand, '#', '_')) END AS name,
    CASE WHEN CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 2 = 0 THEN 'Source' ELSE 'Normalized' END AS kind
  FROM part GROUP BY p_brand),
columns AS (SELECT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS table_id,
    CASE WHEN p_size = 1 THEN 'row_number' WHEN p_size = 2 THEN p_name ELSE replace(p_name, ' ', '_') || '_' || p_size END AS name,
    CASE WHEN p_type = 'ECONOMY' THEN 'date' WHEN p_type = 'PROMO' THEN 'decimal' ELSE 'text' END AS data_type,
    p_size > 45 AS is_required FROM part WHERE p_brand <> 'Brand#5')"""


def definitions(t: Tables) -> tuple[DataFrame, DataFrame]:
    number = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int")
    low = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))
    name = F.when(number % 9 == 0, F.col("p_brand")).when(number % 8 == 0, F.concat(F.lit("pg_"), low)).otherwise(low)
    kind = F.when(number % 2 == 0, "Source").otherwise("Normalized")
    tables = t.part.select("p_brand").distinct().select(number.alias("table_id"), name.alias("name"), kind.alias("kind"))
    size = F.col("p_size")
    column = (
        F.when(size == 1, "row_number").when(size == 2, F.col("p_name"))
        .otherwise(F.concat_ws("_", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), size.cast("string")))
    )
    data_type = F.when(F.col("p_type") == "ECONOMY", "date").when(F.col("p_type") == "PROMO", "decimal").otherwise("text")
    columns = t.part.filter(F.col("p_brand") != "Brand#5").select(
        number.alias("table_id"), column.alias("name"), data_type.alias("data_type"), (size > 45).alias("is_required")
    )
    return tables, columns


def name_problem(c: str) -> str:
    return f"""CASE WHEN NOT regexp_matches({c}, '^[a-z][a-z0-9_]{{0,62}}$') OR starts_with({c}, 'pg_') THEN 'BadName'
      WHEN {c} IN ('id', 'file_job_id', 'row_number', 'imported_at', 'source_row_id', 'row_job_id',
                   'config_version_id', 'normalized_at') THEN 'ReservedName' END"""


@query(
    "validate_tables",
    f"""WITH {DEFS}, found AS (
      SELECT table_id, {name_problem('name')} AS problem, name AS detail FROM tables
      UNION ALL SELECT table_id, {name_problem('name')}, name FROM columns
      UNION ALL SELECT table_id, 'NoColumns', name FROM tables WHERE table_id NOT IN (SELECT table_id FROM columns)
      UNION ALL SELECT table_id, 'DuplicateColumn', name FROM columns GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT table_id, 'SourceNotText', c.name FROM columns c JOIN tables t USING (table_id)
        WHERE kind = 'Source' AND data_type <> 'text'
      UNION ALL SELECT table_id, 'SourceRequired', c.name FROM columns c JOIN tables t USING (table_id)
        WHERE kind = 'Source' AND is_required)
    SELECT DISTINCT * FROM found WHERE problem IS NOT NULL""",
)
def validate_tables(t: Tables) -> DataFrame:
    return G.validate_tables(*definitions(t))


# ---- versions: eight consecutive parts are the rules of one version -------

VERSION_DEFS = """
rules AS (SELECT p_partkey // 8 AS version_id, p_partkey // 80 AS config_id, (p_partkey // 8) % 10 + 1 AS version_no,
    'h' || (p_partkey % 7) AS csv_header, 'col_' || p_size AS source_column,
    lower(replace(p_brand, '#', '_')) AS normalized_column,
    CASE p_type WHEN 'ECONOMY' THEN 'yyyy-MM-dd' WHEN 'PROMO' THEN 'yyyy-QQ' END AS format FROM part),
cols AS (SELECT DISTINCT 'src' AS side, 'col_' || p_size AS name, 'text' AS data_type, FALSE AS is_required
         FROM part WHERE p_size <= 45
  UNION ALL SELECT 'norm', lower(replace(p_brand, '#', '_')),
    CASE WHEN CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 11 = 0 THEN 'money'
      WHEN CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 3 = 0 THEN 'date' ELSE 'text' END,
    CAST(replace(p_brand, 'Brand#', '') AS INTEGER) = 7
  FROM part WHERE p_brand <> 'Brand#11' GROUP BY p_brand)"""


def versions(t: Tables) -> DataFrame:
    """Versions with JSON rules. Eight rules each by construction, so the lists stay small."""
    key = F.col("p_partkey")
    norm = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))
    fmt = F.when(F.col("p_type") == "ECONOMY", "yyyy-MM-dd").when(F.col("p_type") == "PROMO", "yyyy-QQ")
    source = F.concat(F.lit("col_"), F.col("p_size").cast("string"))
    to_source = F.struct(
        F.concat(F.lit("h"), (key % 7).cast("string")).alias("csvHeader"), source.alias("sourceColumn")
    )
    to_target = F.struct(source.alias("sourceColumn"), norm.alias("normalizedColumn"), fmt.alias("format"))
    return (
        t.part.groupBy(F.floor(key / 8).alias("version_id"))
        .agg(
            G.rules_json(G.FILE_TO_SOURCE, F.collect_list(to_source)).alias("file_to_source"),
            G.rules_json(G.SOURCE_TO_NORMALIZED, F.collect_list(to_target)).alias("source_to_normalized"),
        )
        .select(
            "version_id", F.floor(F.col("version_id") / 10).alias("config_id"),
            (F.col("version_id") % 10 + 1).alias("version_no"), "file_to_source", "source_to_normalized",
        )
        .withColumns(
            {"source_table_id": (F.col("config_id") % 2 * 2 + 1).cast("int"), "normalized_table_id": (F.col("config_id") % 2 * 2 + 2).cast("int")}
        )
    )


def version_columns(t: Tables) -> DataFrame:
    """Even configs use tables 1 and 2, odd ones 3 and 4, of the same columns."""
    number = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int")
    source = t.part.filter(F.col("p_size") <= 45).select(
        F.explode(F.array(F.lit(1), F.lit(3))).alias("table_id"), F.concat(F.lit("col_"), F.col("p_size").cast("string")).alias("name"),
        F.lit("text").alias("data_type"), F.lit(False).alias("is_required"), F.col("p_size").alias("ordinal"),
    )
    target = t.part.filter(F.col("p_brand") != "Brand#11").select(
        F.explode(F.array(F.lit(2), F.lit(4))).alias("table_id"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))).alias("name"),
        F.when(number % 11 == 0, "money").when(number % 3 == 0, "date").otherwise("text").alias("data_type"), (number == 7).alias("is_required"),
        number.alias("ordinal"),
    )
    return source.unionByName(target).distinct()


@query(
    "config_rules",
    f"""WITH {VERSION_DEFS} SELECT version_id, config_id, version_no, source_column, normalized_column, format,
      data_type, is_required FROM rules LEFT JOIN cols ON side = 'norm' AND name = normalized_column""",
)
def config_rules(t: Tables) -> DataFrame:
    """Rules out of the JSON snapshots, with the definition of the target column."""
    parsed = G.parse_rules(versions(t))
    defs = version_columns(t).select(
        F.col("table_id").alias("normalized_table_id"), F.col("name").alias("normalized_column"), "data_type", "is_required"
    )
    return (
        G.target_rules(parsed)
        .join(parsed.select("version_id", "config_id", "version_no", "normalized_table_id"), "version_id")
        .join(defs, ["normalized_table_id", "normalized_column"], "left")
        .drop("normalized_table_id")
    )


@query(
    "validate_versions",
    f"""WITH {VERSION_DEFS}, found AS (
      SELECT version_id, 'UnknownSourceColumn' AS problem, source_column AS detail FROM rules
        WHERE source_column NOT IN (SELECT name FROM cols WHERE side = 'src')
      UNION ALL SELECT version_id, 'UnknownTargetColumn', normalized_column FROM rules
        WHERE normalized_column NOT IN (SELECT name FROM cols WHERE side = 'norm')
      UNION ALL SELECT version_id, 'DuplicateCsvHeader', csv_header FROM rules GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT version_id, 'DuplicateTarget', normalized_column FROM rules GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT v.version_id, 'RequiredUnmapped', c.name FROM (SELECT DISTINCT version_id FROM rules) v, cols c
        WHERE c.is_required AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.version_id = v.version_id AND r.normalized_column = c.name)
      UNION ALL SELECT version_id, 'BadDateFormat', format FROM rules JOIN cols ON side = 'norm' AND name = normalized_column
        WHERE data_type = 'date' AND format = 'yyyy-QQ'
      UNION ALL SELECT version_id, 'UnsupportedType', normalized_column FROM rules JOIN cols ON side = 'norm' AND name = normalized_column
        WHERE data_type = 'money')
    SELECT DISTINCT * FROM found""",
)
def validate_versions(t: Tables) -> DataFrame:
    return G.validate_versions(G.parse_rules(versions(t)), version_columns(t))


@query(
    "next_version",
    f"""WITH {VERSION_DEFS} SELECT config_id, max(version_no) + 1 AS next_version FROM rules GROUP BY config_id""",
)
def next_version(t: Tables) -> DataFrame:
    return G.next_version(versions(t))


@query(
    "number_versions",
    f"""WITH {VERSION_DEFS}, highest AS (SELECT config_id, max(version_no) AS top FROM rules GROUP BY config_id)
    SELECT s_suppkey AS draft_id, s_nationkey AS config_id, coalesce(top, 0)
      + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS version_no
    FROM supplier LEFT JOIN highest ON config_id = s_nationkey""",
)
def number_versions(t: Tables) -> DataFrame:
    """Suppliers as drafts of their nation's config."""
    drafts = t.supplier.select(F.col("s_suppkey").alias("draft_id"), F.col("s_nationkey").cast("bigint").alias("config_id"))
    out = G.number_versions(drafts, versions(t), ["draft_id"], id_range(F.col("draft_id")))
    return out.withColumn("config_id", F.col("config_id").cast("int"))


@query(
    "attach_config",
    f"""WITH {VERSION_DEFS} SELECT s_suppkey AS file_job_id, s_suppkey AS version_id, count(csv_header) AS n_file_rules,
      count(format) AS n_formats FROM supplier LEFT JOIN rules ON version_id = s_suppkey GROUP BY ALL""",
)
def attach_config(t: Tables) -> DataFrame:
    jobs = t.supplier.select(F.col("s_suppkey").alias("file_job_id"), F.col("s_suppkey").alias("version_id"))
    with_rules = G.attach_config(jobs, G.parse_rules(versions(t)))
    formats = F.filter("source_to_normalized", lambda r: r["format"].isNotNull())
    return with_rules.select(
        "file_job_id", "version_id",
        F.coalesce(F.size("file_to_source"), F.lit(0)).cast("bigint").alias("n_file_rules"),
        F.coalesce(F.size(formats), F.lit(0)).cast("bigint").alias("n_formats"),
    )


# ---- pinning: a signup activates a version for its user -------------------

ACTIVATIONS = """activations AS (SELECT user_id AS config_id, ts AS activated_at, CAST(floor(value) AS INTEGER) AS version_id
  FROM events WHERE event_type = 'signup'),
files AS (SELECT event_id AS file_job_id, user_id AS config_id, ts AS received_at FROM events WHERE event_type <> 'signup')"""


def activations(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") == "signup").select(
        F.col("user_id").alias("config_id"), F.col("ts").alias("activated_at"), F.floor("value").cast("int").alias("version_id")
    )


def received(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") != "signup").select(
        F.col("event_id").alias("file_job_id"), F.col("user_id").alias("config_id"), F.col("ts").alias("received_at")
    )


@query(
    "pin_version",
    f"""WITH {ACTIVATIONS} SELECT f.file_job_id, f.config_id, a.version_id FROM files f
    ASOF LEFT JOIN activations a ON f.config_id = a.config_id AND f.received_at >= a.activated_at""",
)
def pin_version(t: Tables) -> DataFrame:
    return G.pin_version(received(t), activations(t)).select("file_job_id", "config_id", "version_id")


@query(
    "activation_intervals",
    f"""WITH {ACTIVATIONS} SELECT config_id, version_id, epoch_us(activated_at) AS from_us,
      epoch_us(lead(activated_at) OVER (PARTITION BY config_id ORDER BY activated_at)) AS until_us FROM activations""",
)
def activation_intervals(t: Tables) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return G.activation_intervals(activations(t)).select(
        "config_id", "version_id", us("activated_at").alias("from_us"), us("active_until").alias("until_us")
    )


@query(
    "rollback_pin",
    f"""WITH {ACTIVATIONS}, pinned AS (SELECT f.config_id, a.version_id FROM files f
      ASOF JOIN activations a ON f.config_id = a.config_id AND f.received_at >= a.activated_at),
    top AS (SELECT config_id, max(version_id) AS highest FROM activations GROUP BY config_id)
    SELECT config_id, highest, count(*) FILTER (version_id < highest) AS on_older, count(*) AS n_files
    FROM pinned JOIN top USING (config_id) GROUP BY ALL""",
)
def rollback_pin(t: Tables) -> DataFrame:
    """Files that run on an older version than the highest their config ever had."""
    top = activations(t).groupBy("config_id").agg(F.max("version_id").alias("highest"))
    pinned = G.pin_version(received(t), activations(t)).filter(F.col("version_id").isNotNull())
    per_version = pinned.groupBy("config_id", "version_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_version.join(top, "config_id")
        .groupBy("config_id", "highest")
        .agg(
            F.coalesce(F.sum(F.when(F.col("version_id") < F.col("highest"), F.col("n"))), F.lit(0)).alias("on_older"),
            F.sum("n").alias("n_files"),
        )
    )
