"""Queries: normalization, attempts, status, retry and reprocess on orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.functions.convert import Field
from rowforge.operators import attempts as A
from rowforge.operators import config as G
from rowforge.operators import intake as I
from rowforge.operators import normalize as N
from rowforge.operators.ordered import id_range, number_rows
from rowforge.plans.catalog import Tables, query
from rowforge.plans.samples import ORDER_FIELDS, ORDER_TEXT_SQL, amount_number, day_text, order_text, typed_sql
from rowforge.session import fresh_path, stage
from rowforge.sinks.tables import evolve_table

TYPED = f"WITH {ORDER_TEXT_SQL}, {typed_sql()}"
ERROR_ARMS = " UNION ALL ".join(
    f"SELECT source_row_id, file_job_id, row_number, '{f}' AS field, r_{f} AS reason FROM typed WHERE r_{f} IS NOT NULL"
    for f in ("order_no", "customer_name", "order_date", "amount", "is_paid")
)
VALUES_SQL = """source_row_id, file_job_id, row_number, order_no, customer_name,
  strftime(order_date, '%Y-%m-%d') AS order_date, CAST(CAST(amount AS DECIMAL(15,2)) AS DOUBLE) AS amount, is_paid, note"""


def results(t: Tables) -> DataFrame:
    return N.normalize(order_text(t.orders), ORDER_FIELDS)


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        *N.LINEAGE, "order_no", "customer_name", day_text("order_date"), amount_number("amount"), "is_paid", "note",
        *more,
    )


@query("normalize_valid", f"{TYPED} SELECT {VALUES_SQL} FROM typed_status WHERE status = 'Done'")
def normalize_valid(t: Tables) -> DataFrame:
    return shown(N.valid_rows(results(t)))


@query("normalize_errors", f"{TYPED} {ERROR_ARMS}")
def normalize_errors(t: Tables) -> DataFrame:
    return N.row_errors(results(t))


@query(
    "normalize_summary",
    f"""{TYPED}, errs AS ({ERROR_ARMS})
    SELECT '(valid rows)' AS field, '' AS reason, count(*) AS n FROM typed_status WHERE status = 'Done'
    UNION ALL SELECT field, reason, count(*) AS n FROM errs GROUP BY field, reason""",
)
def normalize_summary(t: Tables) -> DataFrame:
    """Valid rows and errors per field and reason, from one pass over the rows."""
    ok = F.struct(F.lit("(valid rows)").alias("field"), F.lit("").alias("reason"))
    return (
        results(t)
        .select(F.explode(F.when(F.size("errors") == 0, F.array(ok)).otherwise(F.col("errors"))).alias("e"))
        .groupBy("e.field", "e.reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---- attempts over two rule versions -------------------------------------
# Version 1 reads dates as yyyy-MM-dd, version 2 as dd/MM/yyyy.

FIELDS_V2 = [Field("order_date", "order_date", "date", True, "dd/MM/yyyy") if f.target == "order_date" else f
             for f in ORDER_FIELDS]
BOTH = f"{TYPED}, {typed_sql('%d/%m/%Y', '^[0-9]{2}/[0-9]{2}/[0-9]{4}$', 'typed2')}"
FIRST_RUN = f"""{BOTH}, run1 AS (
  SELECT CAST(1 AS BIGINT) AS run_id, source_row_id, file_job_id, row_number, 1 AS config_version_id,
    'Initial' AS kind, CASE WHEN source_row_id % 41 = 0 THEN 'Pending' WHEN source_row_id % 37 = 0 THEN 'Failed'
                            ELSE status END AS status FROM typed_status)"""
ATTEMPTS = f"""{FIRST_RUN}, attempts AS (
  SELECT * FROM run1 UNION ALL
  SELECT CAST(2 AS BIGINT), source_row_id, file_job_id, row_number, 2, 'Reprocess', status FROM typed2_status
  WHERE source_row_id NOT IN (SELECT source_row_id FROM run1 WHERE status = 'Pending'))"""
LAST = f"""{ATTEMPTS}, last AS (
  SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY source_row_id ORDER BY run_id DESC) = 1),
counts AS (
  SELECT file_job_id, count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Done') AS done,
    count(*) FILTER (status = 'Invalid') AS invalid, count(*) FILTER (status = 'Failed') AS failed FROM last GROUP BY file_job_id)"""
JOBS = """jobs AS (SELECT c_custkey AS file_job_id,
  CASE WHEN c_custkey % 29 = 0 THEN 'ImportFailed' WHEN c_custkey % 31 = 0 THEN 'Importing' ELSE 'Imported' END
  AS import_status FROM customer)"""


def run1(t: Tables) -> DataFrame:
    k = F.col("source_row_id")
    first = results(t).withColumn(
        "status", F.when(k % 41 == 0, N.PENDING).when(k % 37 == 0, N.FAILED).otherwise(F.col("status"))
    )
    return A.append_attempts(first, 1, "Initial", F.lit(1))


def queue(t: Tables) -> DataFrame:
    """Row jobs before they ran: some still wait."""
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("source_row_id"), F.when(k % 41 == 0, N.PENDING).otherwise(N.DONE).alias("status"))


def run2_results(t: Tables) -> DataFrame:
    """Reprocess with version 2, refused for rows still pending."""
    stored = A.source_for_reprocess(order_text(t.orders), [f.source for f in FIELDS_V2])
    return N.normalize(A.without_overlap(stored, queue(t)), FIELDS_V2)


def attempts(t: Tables) -> DataFrame:
    return run1(t).unionByName(A.append_attempts(run2_results(t), 2, "Reprocess", F.lit(2)))


def jobs(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    status = F.when(k % 29 == 0, "ImportFailed").when(k % 31 == 0, "Importing").otherwise("Imported")
    return t.customer.select(k.alias("file_job_id"), status.alias("import_status"))


@query(
    "source_rows",
    """SELECT o_custkey AS file_job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_number,
      CAST(o_orderkey AS VARCHAR) AS order_no, o_orderstatus AS order_status, '2026-01-01' AS imported_on FROM orders""",
)
def source_rows(t: Tables) -> DataFrame:
    numbered = number_rows(t.orders, ["o_custkey"], ["o_orderkey"], id_range(F.col("o_orderkey")))
    source = N.project_to_source(
        numbered, [("o_orderkey", "order_no"), ("o_orderstatus", "order_status")], ("o_custkey", "row_number")
    )
    lined = N.with_lineage(source, F.col("o_custkey"), F.lit("2026-01-01").cast("timestamp"))
    return lined.select(
        "file_job_id", "row_number", "order_no", "order_status",
        F.date_format("imported_at", "yyyy-MM-dd").alias("imported_on"),
    )


@query("attempts", f"{ATTEMPTS} SELECT * FROM attempts")
def attempt_log(t: Tables) -> DataFrame:
    return attempts(t)


@query("file_counts", f"{LAST} SELECT * FROM counts")
def file_counts(t: Tables) -> DataFrame:
    return A.file_counts(attempts(t))


@query(
    "file_status",
    f"""{LAST}, {JOBS} SELECT file_job_id, import_status, coalesce(pending, 0) AS pending, coalesce(done, 0) AS done,
      coalesce(invalid, 0) AS invalid, coalesce(failed, 0) AS failed,
      CASE WHEN import_status <> 'Imported' OR coalesce(pending, 0) > 0 THEN 'InProgress'
           WHEN coalesce(invalid, 0) + coalesce(failed, 0) > 0 THEN 'CompletedWithErrors'
           ELSE 'Completed' END AS normalization_status
    FROM jobs LEFT JOIN counts USING (file_job_id)""",
)
def file_status(t: Tables) -> DataFrame:
    return A.file_status(jobs(t), A.file_counts(attempts(t)))


@query(
    "total_rows",
    f"""WITH {JOBS} SELECT file_job_id, import_status,
      CASE WHEN import_status = 'Imported' THEN (SELECT count(*) FROM orders WHERE o_custkey = file_job_id) END
      AS total_rows FROM jobs""",
)
def total_rows(t: Tables) -> DataFrame:
    return I.total_rows(t.orders.select(F.col("o_custkey").alias("file_job_id")), jobs(t))


@query(
    "row_state",
    f"""{ATTEMPTS} SELECT source_row_id, arg_max(status, run_id) AS latest_status,
      arg_max(config_version_id, run_id) AS latest_version,
      max(run_id) FILTER (status = 'Done') AS current_run,
      arg_max(config_version_id, run_id) FILTER (status = 'Done') AS current_version,
      count(*) AS n_attempts FROM attempts GROUP BY source_row_id""",
)
def row_state(t: Tables) -> DataFrame:
    return A.row_state(attempts(t))


@query(
    "row_history",
    f"""{ATTEMPTS} SELECT *, row_number() OVER (PARTITION BY source_row_id ORDER BY run_id) AS attempt_no
    FROM attempts""",
)
def row_history(t: Tables) -> DataFrame:
    return A.row_history(attempts(t), id_range(F.col("run_id")))


CURRENT = f"""{ATTEMPTS}, done AS (
  SELECT 1 AS run_id, 1 AS config_version_id, * FROM typed_status
    WHERE status = 'Done' AND source_row_id % 41 <> 0 AND source_row_id % 37 <> 0
  UNION ALL SELECT 2, 2, * FROM typed2_status WHERE status = 'Done'
    AND source_row_id NOT IN (SELECT source_row_id FROM run1 WHERE status = 'Pending'))
SELECT {VALUES_SQL}, config_version_id FROM done
QUALIFY row_number() OVER (PARTITION BY source_row_id ORDER BY run_id DESC) = 1"""


def current_normalized(t: Tables) -> DataFrame:
    """Version 1 results, then the Done rows of version 2 on top; failed rows keep what they had."""
    k = F.col("source_row_id")
    settled = results(t).filter((k % 41 != 0) & (k % 37 != 0))
    old = N.valid_rows(settled).withColumns({"run_id": F.lit(1), "config_version_id": F.lit(1)})
    new = N.valid_rows(run2_results(t)).withColumns({"run_id": F.lit(2), "config_version_id": F.lit(2)})
    return A.upsert_normalized(old, new)


@query("upsert_current", CURRENT)
def upsert_current(t: Tables) -> DataFrame:
    return shown(current_normalized(t), "config_version_id")


@query(
    "reprocess",
    f"""{ATTEMPTS}, per_row AS (
      SELECT file_job_id, source_row_id, arg_max(config_version_id, run_id) FILTER (status = 'Done') AS version,
        arg_max(status, run_id) AS latest_status FROM attempts GROUP BY ALL)
    SELECT file_job_id, count(*) FILTER (version = 1) AS kept_v1, count(*) FILTER (version = 2) AS now_v2,
      count(*) FILTER (version IS NULL) AS without_result,
      count(*) FILTER (version IS NOT NULL AND latest_status <> 'Done') AS failed_but_kept FROM per_row GROUP BY file_job_id""",
)
def reprocess(t: Tables) -> DataFrame:
    """Per file: what a reprocess replaced, and what a failed one left in place."""
    log = attempts(t)
    files = log.groupBy("source_row_id").agg(F.min("file_job_id").alias("file_job_id"))
    version = F.col("current_version")
    return (
        A.row_state(log)
        .join(files, "source_row_id")
        .groupBy("file_job_id")
        .agg(
            F.count_if(version == 1).alias("kept_v1"),
            F.count_if(version == 2).alias("now_v2"),
            F.count_if(version.isNull()).alias("without_result"),
            F.count_if(version.isNotNull() & (F.col("latest_status") != N.DONE)).alias("failed_but_kept"),
        )
    )


@query(
    "source_for_reprocess",
    f"""{BOTH} SELECT file_job_id, count(*) AS n_source, count(*) FILTER (status = 'Done') AS n_done FROM typed2_status
    GROUP BY file_job_id""",
)
def source_for_reprocess(t: Tables) -> DataFrame:
    stored = A.source_for_reprocess(order_text(t.orders), [f.source for f in FIELDS_V2])
    return (
        N.normalize(stored, FIELDS_V2)
        .groupBy("file_job_id")
        .agg(F.count(F.lit(1)).alias("n_source"), F.count_if(F.col("status") == N.DONE).alias("n_done"))
    )


@query(
    "retry_eligible",
    f"""{LAST} SELECT source_row_id, status, status = 'Failed' AS accepted,
      CASE WHEN status <> 'Failed' THEN 'NotRetryable:' || status END AS refusal FROM last""",
)
def retry_eligible(t: Tables) -> DataFrame:
    return A.eligible_for_retry(A.latest_attempts(attempts(t)).select("source_row_id", "status"), N.FAILED)


@query(
    "file_retry_eligible",
    f"""WITH {JOBS} SELECT file_job_id, import_status AS status, import_status = 'ImportFailed' AS accepted,
      CASE WHEN import_status <> 'ImportFailed' THEN 'NotRetryable:' || import_status END AS refusal FROM jobs""",
)
def file_retry_eligible(t: Tables) -> DataFrame:
    """Only files whose import failed may be imported again."""
    return A.eligible_for_retry(jobs(t).withColumnRenamed("import_status", "status"), "ImportFailed")


@query(
    "retry_rows",
    f"""{FIRST_RUN} SELECT r.run_id, source_row_id, r.file_job_id, r.row_number, r.config_version_id, r.kind,
      CASE WHEN r.status = 'Failed' THEN s.status ELSE r.status END AS status
    FROM run1 r JOIN typed_status s USING (source_row_id)""",
)
def retry_rows(t: Tables) -> DataFrame:
    return A.retry_rows(run1(t), results(t))


@query(
    "retry_status",
    f"""{FIRST_RUN}, after AS (SELECT r.file_job_id, CASE WHEN r.status = 'Failed' THEN s.status ELSE r.status END AS status
      FROM run1 r JOIN typed_status s USING (source_row_id))
    SELECT file_job_id, count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Done') AS done,
      count(*) FILTER (status = 'Invalid') AS invalid, count(*) FILTER (status = 'Failed') AS failed,
      CASE WHEN count(*) FILTER (status = 'Pending') > 0 THEN 'InProgress'
        WHEN count(*) FILTER (status IN ('Invalid', 'Failed')) > 0 THEN 'CompletedWithErrors' ELSE 'Completed' END AS normalization_status
    FROM after GROUP BY file_job_id""",
)
def retry_status(t: Tables) -> DataFrame:
    """Counts and status per file after a retry of its failed rows, from the counts before and the changed rows alone."""
    log = stage(run1(t), "attempts")
    changed = A.retry_failed(log, order_text(t.orders), lambda rows: N.normalize(rows, ORDER_FIELDS))
    return A.recount(A.file_counts(log), changed).withColumn("normalization_status", A.normalization_status(F.lit("Imported")))


@query("overlap", f"{FIRST_RUN} SELECT source_row_id, file_job_id FROM run1 WHERE status = 'Pending'")
def overlap(t: Tables) -> DataFrame:
    requests = order_text(t.orders).select("source_row_id", "file_job_id")
    return A.overlap_conflicts(requests, run1(t))


NUMBERED = """numbered AS (SELECT o_custkey AS file_job_id, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_number FROM orders)"""


def numbered(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("file_job_id"), "o_orderkey")
    return number_rows(rows, ["file_job_id"], ["o_orderkey"], id_range(F.col("o_orderkey")))


@query("retry_new_rows", f"WITH {NUMBERED} SELECT * FROM numbered WHERE row_number >= 5")
def retry_new_rows(t: Tables) -> DataFrame:
    """A first import stopped at row 5 of every file; the retry adds only the rest."""
    every = numbered(t)
    return I.new_rows_only(every, every.filter(F.col("row_number") < 5))


@query(
    "selected_rows",
    f"""{TYPED} SELECT source_row_id, file_job_id, status FROM typed_status
    WHERE (file_job_id, row_number) IN (SELECT o_custkey, max(o_orderkey) FROM orders GROUP BY o_custkey)""",
)
def selected_rows(t: Tables) -> DataFrame:
    """Reprocess of chosen rows: the newest row of every file."""
    text = order_text(t.orders)
    chosen = text.groupBy("file_job_id").agg(F.max("row_number").alias("row_number"))
    return N.normalize(A.select_rows(text, chosen), ORDER_FIELDS).select("source_row_id", "file_job_id", "status")


@query(
    "file_errors",
    f"""{ATTEMPTS}, errs AS (SELECT 1 AS run_id, * FROM ({ERROR_ARMS})
      UNION ALL SELECT 2 AS run_id, * FROM ({ERROR_ARMS.replace("FROM typed ", "FROM typed2 ")}))
    SELECT e.* FROM errs e JOIN (SELECT source_row_id, max(run_id) AS run_id FROM attempts GROUP BY ALL) l
      USING (source_row_id, run_id) WHERE source_row_id NOT IN (SELECT source_row_id FROM run1 WHERE status = 'Pending')""",
)
def file_errors(t: Tables) -> DataFrame:
    """Errors of each row's latest run, by file and row number."""
    pending = F.col("source_row_id") % 41 == 0
    first = results(t).withColumns({"run_id": F.lit(1), "status": F.when(pending, N.PENDING).otherwise(F.col("status"))})
    return A.file_errors(first.unionByName(run2_results(t).withColumn("run_id", F.lit(2))))


@query(
    "page",
    """SELECT c_mktsegment, c_custkey, c_name FROM customer
    WHERE c_mktsegment > 'BUILDING' OR (c_mktsegment = 'BUILDING' AND c_custkey > 40)
    ORDER BY c_mktsegment, c_custkey LIMIT 25""",
)
def page(t: Tables) -> DataFrame:
    rows = t.customer.select("c_mktsegment", "c_custkey", "c_name")
    return A.page(rows, ["c_mktsegment", "c_custkey"], ["BUILDING", 40], 25)


@query(
    "schema_merge",
    """WITH c AS (SELECT p_brand AS table_id, 'c' || p_size AS name, p_partkey % 2 AS side, min(p_partkey) % 9 AS k FROM part GROUP BY ALL),
    d AS (SELECT *, CASE WHEN k < 4 THEN 'text' WHEN k < 7 THEN 'date' WHEN k = 7 AND side = 0 THEN 'money' ELSE 'decimal' END AS data_type FROM c),
    j AS (SELECT coalesce(s.table_id, n.table_id) AS table_id, coalesce(s.name, n.name) AS name, s.data_type AS st, n.data_type AS de
      FROM (SELECT * FROM d WHERE side = 1) s FULL JOIN (SELECT * FROM d WHERE side = 0) n ON s.table_id = n.table_id AND s.name = n.name),
    a AS (SELECT *, CASE WHEN de IS NULL THEN 'Missing' WHEN de = 'money' THEN 'Refused' WHEN st IS NULL THEN 'Added' WHEN st <> de THEN 'Refused' ELSE 'Kept' END AS action FROM j)
    SELECT table_id, name, coalesce(st, CASE WHEN action = 'Added' THEN de END) AS data_type, action,
      CASE WHEN action = 'Refused' THEN CASE WHEN de = 'money' THEN 'UnsupportedType:money' ELSE 'TypeChange:' || st || '>' || de END END AS reason FROM a""",
)
def schema_merge(t: Tables) -> DataFrame:
    """Brands as tables, sizes as their columns: odd parts define the stored version, even ones the new definition."""
    side = F.col("p_partkey") % 2
    columns = t.part.groupBy(F.col("p_brand").alias("table_id"), F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("name"), side.alias("side")).agg((F.min("p_partkey") % 9).alias("k"))
    kind = F.when(F.col("k") < 4, "text").when(F.col("k") < 7, "date").when((F.col("k") == 7) & (F.col("side") == 0), "money").otherwise("decimal")
    typed = columns.select("table_id", "name", "side", kind.alias("data_type"))
    return G.merge_columns(typed.where("side = 1"), typed.where("side = 0"))


@query(
    "schema_evolution",
    """SELECT o_orderkey, o_orderstatus AS state, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS priority,
      CAST(NULL AS BOOLEAN) AS checked FROM orders""",
)
def schema_evolution(t: Tables) -> DataFrame:
    """A column added later is null in rows written before; a column nobody filled is null everywhere."""
    path = fresh_path(t.spark, "evolving")
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority"))
    evolve_table(rows.filter("state <> 'O'").drop("priority"), path)
    return G.evolve(evolve_table(rows.filter("state = 'O'"), path), [("state", "text"), ("priority", "text"), ("checked", "boolean")])
