"""Queries: recovery, correlation, comparison, export, archive and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions import keys as Y
from rowforge.functions import rules as U
from rowforge.functions.convert import Field
from rowforge.functions.keys import OPERATION_KEY
from rowforge.functions.text import masked, system_id_parts
from rowforge.operators import archive as R
from rowforge.operators import attempts as A
from rowforge.operators import compare as M
from rowforge.operators import correlate as O
from rowforge.operators import export as E
from rowforge.operators import monitor as Q
from rowforge.operators import normalize as N
from rowforge.operators import recovery as V
from rowforge.operators.ordered import time_range
from rowforge.plans.catalog import Tables, query
from rowforge.plans.core import TYPED, jobs
from rowforge.plans.samples import ORDER_FIELDS, order_text
from rowforge.plans.transfer import HEADERS_SQL, headers
from rowforge.session import fresh_path, spread
from rowforge.sinks.publish import publish


def micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


# ---- recovery -----------------------------------------------------------

KEY_PARTS = ("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "'PRIMARY'", "l_suppkey")
KEY_SQL = "sha256(" + " || '|' || ".join(
    f"length(CAST({p} AS VARCHAR)) || ':' || {p}" for p in KEY_PARTS
) + ")"
OPS_SQL = f"""ops AS (SELECT {KEY_SQL} AS operation_key, l_orderkey, l_linenumber, 1 AS expected_rows FROM lineitem),
ledger AS (SELECT {KEY_SQL} AS operation_key, CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS committed_at,
  CASE WHEN l_quantity > 5 THEN 1 ELSE 0 END AS affected_rows FROM lineitem WHERE l_returnflag <> 'R')"""


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "file_id": F.col("l_orderkey"), "sheet_id": F.col("l_returnflag"), "source_row_id": F.col("l_linenumber"),
            "target_id": F.col("l_partkey"), "operation_type": F.lit("PRIMARY"), "business_revision": F.col("l_suppkey"),
        }
    )


def planned(t: Tables) -> DataFrame:
    return keyed(t.lineitem).select(*OPERATION_KEY, "l_orderkey", "l_linenumber", F.lit(1).alias("expected_rows"))


def ledger(t: Tables) -> DataFrame:
    """Returned lines never ran; open lines have no commit time; small ones wrote nothing."""
    return keyed(t.lineitem.filter(F.col("l_returnflag") != "R")).select(
        *OPERATION_KEY, F.when(F.col("l_linestatus") == "O", F.col("l_shipdate")).alias("committed_at"),
        F.when(F.col("l_quantity") > 5, 1).otherwise(0).alias("affected_rows"),
    )


@query(
    "resume_failed",
    f"""WITH {OPS_SQL} SELECT operation_key, l_orderkey, l_linenumber FROM ops
    WHERE operation_key NOT IN (SELECT operation_key FROM ledger WHERE committed_at IS NOT NULL)""",
)
def resume_failed(t: Tables) -> DataFrame:
    return V.resume_failed(planned(t), ledger(t)).select("operation_key", "l_orderkey", "l_linenumber")


@query(
    "classify_recovery",
    f"""WITH {OPS_SQL}, c AS (SELECT operation_key, CASE WHEN l.operation_key IS NULL THEN 'NotStarted' WHEN committed_at IS NULL THEN 'Unknown'
        WHEN affected_rows < expected_rows THEN 'Partial' ELSE 'Committed' END AS crash_point
      FROM ops LEFT JOIN ledger l USING (operation_key))
    SELECT *, CASE crash_point WHEN 'NotStarted' THEN 'Retry' WHEN 'Committed' THEN 'Skip' WHEN 'Partial' THEN 'ResumeRest' ELSE 'Review' END AS action
    FROM c""",
)
def classify_recovery(t: Tables) -> DataFrame:
    return V.classify_recovery(planned(t), ledger(t))


@query(
    "idempotency",
    """SELECT event_type, user_id, count(*) AS n_requests, CASE WHEN count(DISTINCT props) > 1 THEN 'Conflict'
      WHEN count(*) > 1 THEN 'Repeated' ELSE 'New' END AS verdict FROM events GROUP BY event_type, user_id""",
)
def idempotency(t: Tables) -> DataFrame:
    return V.idempotency_check(t.events, ["event_type"], "user_id", Y.content_hash(F.col("props")))


# ---- correlation --------------------------------------------------------

BY_DAY = """m AS (SELECT event_type, user_id || '|' || strftime(ts, '%Y%m%d') AS business_key, ts FROM events)"""


@query(
    "correlate",
    f"""WITH {BY_DAY}, a AS (SELECT business_key, count(*) FILTER (event_type = 'signup') AS n_notice,
        count(*) FILTER (event_type = 'purchase') AS n_confirm, count(*) FILTER (event_type = 'error') AS n_cancel,
        min(ts) FILTER (event_type = 'signup') AS n, min(ts) FILTER (event_type = 'purchase') AS c, min(ts) FILTER (event_type = 'error') AS x
      FROM m WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY business_key)
    SELECT business_key, n_notice, n_confirm, n_cancel, n_notice = 0 AS orphan,
      n_notice > 1 OR n_confirm > 1 OR n_cancel > 1 AS duplicate, coalesce(c < n, FALSE) OR coalesce(x < n, FALSE) AS out_of_order,
      CASE WHEN n_notice = 0 THEN 'Orphan' WHEN n_cancel > 0 THEN 'Cancelled' WHEN n_confirm > 0 THEN 'Confirmed' ELSE 'Open' END AS outcome
    FROM a""",
)
def correlate(t: Tables) -> DataFrame:
    """Signups are notices, purchases confirmations, errors cancellations; user and day the business key."""
    keyed_events = t.events.withColumn("business_key", F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")))
    of = lambda kind: keyed_events.filter(F.col("event_type") == kind)
    out = O.correlate(of("signup"), of("purchase"), of("error"), ["business_key"], "ts")
    return out.drop("first_notice", "first_confirm", "first_cancel")


@query(
    "orphan_messages",
    f"""WITH {BY_DAY} SELECT business_key, count(*) AS n FROM m WHERE event_type IN ('purchase', 'error')
      AND business_key NOT IN (SELECT business_key FROM m WHERE event_type = 'signup') GROUP BY business_key""",
)
def orphan_messages(t: Tables) -> DataFrame:
    messages = t.events.withColumn("business_key", F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")))
    late = messages.filter(F.col("event_type").isin("purchase", "error"))
    found = O.orphans(late, messages.filter(F.col("event_type") == "signup"), ["business_key"])
    return found.groupBy("business_key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "illegal_transitions",
    """WITH s AS (SELECT event_id, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'Queued' WHEN 'view' THEN 'Running'
        WHEN 'click' THEN 'RetryScheduled' WHEN 'purchase' THEN 'Succeeded' ELSE 'Failed' END AS status, ts FROM events),
    l AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS from_status FROM s)
    SELECT event_id, job_id, status, from_status FROM l WHERE from_status IS NOT NULL
      AND from_status || '>' || status NOT IN ('Queued>Running', 'Running>RetryScheduled', 'Running>Succeeded', 'Running>Failed', 'RetryScheduled>Queued')""",
)
def illegal_transitions(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "Queued").when(kind == "view", "Running").when(kind == "click", "RetryScheduled")
        .when(kind == "purchase", "Succeeded").otherwise("Failed")
    )
    log = t.events.select("event_id", F.col("user_id").alias("job_id"), status.alias("status"), "ts")
    return O.illegal_transitions(log, "job_id", ["ts", "event_id"], "job", time_range(F.col("ts"), 86400)).drop("ts")


# ---- comparison ---------------------------------------------------------

GOLDEN = """golden AS (SELECT p_partkey, CASE WHEN p_size = 9 THEN p_name || '?' ELSE p_name END AS p_name, p_brand,
  CASE WHEN p_size = 7 THEN NULL ELSE p_type END AS p_type FROM part WHERE p_size <> 11
  UNION ALL SELECT -1 - s_suppkey, s_name, 'Brand#0', 'EXTRA' FROM supplier WHERE s_acctbal < 0),
ours AS (SELECT p_partkey, p_name, p_brand, p_type FROM part)"""


def golden(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Our parts and a golden copy with changed, missing and extra rows."""
    ours = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    changed = t.part.filter(F.col("p_size") != 11).select(
        "p_partkey", F.when(F.col("p_size") == 9, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("p_name"),
        "p_brand", F.when(F.col("p_size") != 7, F.col("p_type")).alias("p_type"),
    )
    extra = t.supplier.filter(F.col("s_acctbal") < 0).select(
        (-1 - F.col("s_suppkey")).alias("p_partkey"), F.col("s_name").alias("p_name"), F.lit("Brand#0").alias("p_brand"),
        F.lit("EXTRA").alias("p_type"),
    )
    return ours, changed.unionByName(extra)


@query(
    "parity",
    f"""WITH {GOLDEN}, j AS (SELECT coalesce(o.p_partkey, g.p_partkey) AS p_partkey, o.p_partkey AS ok, g.p_partkey AS gk,
      o.p_name AS on_, g.p_name AS gn, o.p_type AS ot, g.p_type AS gt FROM ours o FULL JOIN golden g ON o.p_partkey = g.p_partkey)
    SELECT p_partkey, '(row)' AS "column", 'present' AS left_value, 'missing' AS right_value FROM j WHERE gk IS NULL
    UNION ALL SELECT p_partkey, '(row)', 'missing', 'present' FROM j WHERE ok IS NULL
    UNION ALL SELECT p_partkey, 'p_name', on_, gn FROM j WHERE ok IS NOT NULL AND gk IS NOT NULL AND on_ IS DISTINCT FROM gn
    UNION ALL SELECT p_partkey, 'p_type', ot, gt FROM j WHERE ok IS NOT NULL AND gk IS NOT NULL AND ot IS DISTINCT FROM gt""",
)
def parity(t: Tables) -> DataFrame:
    return M.parity(*golden(t), ["p_partkey"])


@query(
    "set_diff",
    f"""WITH {GOLDEN} SELECT *, 'left' AS side FROM (SELECT * FROM ours EXCEPT ALL SELECT p_partkey, p_name, p_brand, p_type FROM golden)
    UNION ALL SELECT *, 'right' FROM (SELECT p_partkey, p_name, p_brand, p_type FROM golden EXCEPT ALL SELECT * FROM ours)""",
)
def set_diff(t: Tables) -> DataFrame:
    return M.set_diff(*golden(t))


@query(
    "diff_revisions",
    f"""WITH {GOLDEN} SELECT coalesce(o.p_partkey, g.p_partkey) AS p_partkey,
      CASE WHEN o.p_partkey IS NULL THEN 'Added' WHEN g.p_partkey IS NULL THEN 'Removed' ELSE 'Changed' END AS change,
      o.p_name AS old_p_name, o.p_type AS old_p_type, g.p_name AS new_p_name, g.p_type AS new_p_type
    FROM ours o FULL JOIN golden g ON o.p_partkey = g.p_partkey
    WHERE (o.p_partkey IS NULL) OR (g.p_partkey IS NULL) OR o.p_name IS DISTINCT FROM g.p_name OR o.p_type IS DISTINCT FROM g.p_type""",
)
def diff_revisions(t: Tables) -> DataFrame:
    ours, other = (df.drop("p_brand") for df in golden(t))
    return M.diff_revisions(ours, other, ["p_partkey"])


@query(
    "lineage",
    """WITH RECURSIVE r AS (SELECT o_orderkey AS job_id, o_orderkey AS root_job_id, CAST(0 AS BIGINT) AS depth FROM orders WHERE o_orderkey % 16 = 0
      UNION ALL SELECT o_orderkey, root_job_id, depth + 1 FROM r JOIN orders ON o_orderkey = r.job_id + 1 AND o_orderkey % 16 <> 0)
    SELECT * FROM r""",
)
def lineage(t: Tables) -> DataFrame:
    """Every sixteenth order is a first run, the orders after it its reruns."""
    key = F.col("o_orderkey")
    return M.lineage(t.orders.select(key.alias("job_id"), F.when(key % 16 != 0, key - 1).alias("parent_job_id")))


@query(
    "manifest_missing",
    """SELECT s_nationkey AS manifest_id, 'sup_' || s_suppkey AS expected_file FROM supplier
    WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'A' AND l_linenumber = 7)""",
)
def manifest_missing(t: Tables) -> DataFrame:
    return E.missing_from_manifest(*manifest(t))


def manifest(t: Tables) -> tuple[DataFrame, DataFrame]:
    name = lambda c: F.concat(F.lit("sup_"), F.col(c).cast("string"))
    expected = t.supplier.select(F.col("s_nationkey").alias("manifest_id"), name("s_suppkey").alias("expected_file"))
    arrived = t.lineitem.filter((F.col("l_quantity") > 49) & (F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7))
    return expected, arrived.select(name("l_suppkey").alias("file_name"))


@query(
    "manifest_ready",
    """WITH here AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'A' AND l_linenumber = 7)
    SELECT s_nationkey AS manifest_id, count(*) AS expected, count(l_suppkey) AS present, count(*) = count(l_suppkey) AS ready
    FROM supplier LEFT JOIN here ON l_suppkey = s_suppkey GROUP BY s_nationkey""",
)
def manifest_ready(t: Tables) -> DataFrame:
    return E.manifest_ready(*manifest(t))


# ---- export -------------------------------------------------------------


@query(
    "not_exported",
    f"""WITH {HEADERS_SQL} SELECT DISTINCT trans_id FROM headers WHERE system_id = 'TIB-07' AND coalesce(exp_flag, 'N') = 'N'""",
)
def not_exported(t: Tables) -> DataFrame:
    return E.not_exported(headers(t), "TIB-07")


@query(
    "export_selection",
    f"""WITH {HEADERS_SQL} SELECT trans_id, ref_no AS "File", l_linenumber AS "Line", l_partkey AS "Part" FROM headers JOIN lineitem ON l_orderkey = trans_id
    WHERE system_id = 'TIB-07' AND coalesce(exp_flag, 'N') = 'N' AND l_returnflag = 'A'""",
)
def export_selection(t: Tables) -> DataFrame:
    details = t.lineitem.withColumnRenamed("l_orderkey", "trans_id")
    rows = E.export_selection(headers(t), details, "TIB-07", F.col("l_returnflag") == "A")
    return E.export_columns(rows, [("trans_id", "trans_id"), ("ref_no", "File"), ("l_linenumber", "Line"), ("l_partkey", "Part")])


@query(
    "export_file",
    f"""WITH {HEADERS_SQL} SELECT CAST(trans_id AS VARCHAR) AS "Transaction", ref_no AS "File", exp_flag AS "Flag" FROM headers
    WHERE system_id = 'KK-02'""",
)
def export_file(t: Tables) -> DataFrame:
    """Configured columns under their headings in one file of the configured name; a second export replaces the first."""
    folder = fresh_path(t.spark, "export")
    rows = headers(t).filter(F.col("system_id") == "KK-02")
    columns = [("trans_id", "Transaction"), ("ref_no", "File"), ("exp_flag", "Flag")]
    publish(E.export_columns(rows.filter("exp_flag = 'Y'"), columns), folder, "KK-02.csv", 1)
    path = publish(E.export_columns(rows, columns), folder, "KK-02.csv", 2)
    return t.spark.read.option("header", True).schema("Transaction string, File string, Flag string").csv(path)


@query(
    "mark_exported",
    f"""WITH {HEADERS_SQL} SELECT trans_id, system_id, CASE WHEN trans_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
      THEN 'Y' ELSE exp_flag END AS exp_flag FROM headers""",
)
def mark_exported(t: Tables) -> DataFrame:
    published = t.lineitem.filter(F.col("l_returnflag") == "A").select(F.col("l_orderkey").alias("trans_id"))
    return E.mark_exported(headers(t), published).select("trans_id", "system_id", "exp_flag")


ENRICHED = """policy AS (SELECT * FROM (SELECT l_partkey AS chassis, l_suppkey AS agent, l_orderkey * 10 + l_linenumber AS policy_no, l_shipdate AS cc_date
    FROM lineitem WHERE year(l_shipdate) = 1999) QUALIFY row_number() OVER (PARTITION BY chassis, agent ORDER BY cc_date DESC, policy_no DESC) = 1),
motor AS (SELECT o_orderkey * 10 + 1 AS policy_no, o_orderpriority AS cover, CAST(o_custkey AS BIGINT) AS premium FROM orders)"""


@query(
    "export_enriched",
    f"""WITH {ENRICHED} SELECT l_orderkey, l_linenumber, l_partkey AS chassis, l_suppkey AS agent, p.policy_no,
      coalesce(cover, '') AS cover, coalesce(premium, 0) AS premium
    FROM lineitem LEFT JOIN policy p ON chassis = l_partkey AND agent = l_suppkey LEFT JOIN motor m ON m.policy_no = p.policy_no""",
)
def export_enriched(t: Tables) -> DataFrame:
    """Newest policy of the year per chassis and agent, then its motor detail, gaps filled."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("chassis"), F.col("l_suppkey").alias("agent"))
    policy = t.lineitem.select(
        F.col("l_partkey").alias("chassis"), F.col("l_suppkey").alias("agent"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("policy_no"), F.col("l_shipdate").alias("cc_date"),
    )
    motor = t.orders.select(
        (F.col("o_orderkey") * 10 + 1).alias("policy_no"), F.col("o_orderpriority").alias("cover"), F.col("o_custkey").alias("premium")
    )
    enriched = E.enrich_policy(rows, policy, motor, F.lit("1999-06-30").cast("date"))
    return E.fill_enriched(enriched, ["cover"], ["premium"]).drop("cc_date")


# ---- archive ------------------------------------------------------------


@query(
    "archive_status",
    """WITH live AS (SELECT doc_id, sha256(CASE WHEN quality = 0 THEN text || ' ' ELSE text END) AS live_hash
        FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0)
    SELECT d.doc_id, CASE WHEN live_hash IS NULL THEN 'NotArchived' WHEN live_hash = sha256(text) THEN 'Archived' ELSE 'ChangedAfterRead' END
      AS archive_status FROM documents d LEFT JOIN live USING (doc_id)""",
)
def archive_status(t: Tables) -> DataFrame:
    """Low-quality documents changed after the snapshot; toxic ones are gone from their folder."""
    live = t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left").filter(F.coalesce("toxic", F.lit(0)) == 0)
    now = F.when(F.col("quality") == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    return R.archive_status(
        live.select("doc_id", Y.content_hash(now).alias("live_hash")),
        t.documents.select("doc_id", Y.content_hash(F.col("text")).alias("sha256")), "doc_id",
    )


@query(
    "archive_plan",
    """SELECT c_custkey AS file_job_id, 'archive/' || c_nationkey || '/20260131/' || c_custkey || '_' || c_name || '.csv' AS archive_path
    FROM customer WHERE c_custkey % 29 <> 0 AND c_custkey % 31 <> 0""",
)
def archive_plan(t: Tables) -> DataFrame:
    names = t.customer.select(
        F.col("c_custkey").alias("file_job_id"), F.col("c_nationkey").alias("config_id"), F.concat("c_name", F.lit(".csv")).alias("file_name"),
        F.lit("2026-01-31").cast("date").alias("archived_on"),
    )
    return R.archive_plan(names.join(jobs(t), "file_job_id")).select("file_job_id", "archive_path")


STATES = """states AS (SELECT event_id AS job_id, user_id AS partner, event_type AS job_type, ts AS received_at,
  CASE event_type WHEN 'signup' THEN 'Queued' WHEN 'view' THEN 'Running' WHEN 'click' THEN 'Succeeded' WHEN 'purchase' THEN 'Duplicate' ELSE 'Failed' END AS state,
  value AS processing_ms FROM events)"""


def states(t: Tables) -> DataFrame:
    """Events as jobs of a partner with a state and a processing time."""
    kind = F.col("event_type")
    state = (
        F.when(kind == "signup", "Queued").when(kind == "view", "Running").when(kind == "click", "Succeeded")
        .when(kind == "purchase", "Duplicate").otherwise("Failed")
    )
    return t.events.select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("partner"), kind.alias("job_type"),
        F.col("ts").cast("timestamp").alias("received_at"), state.alias("state"), F.col("value").alias("processing_ms"),
    )


@query(
    "pending_finalization",
    f"""WITH {STATES}, j AS (SELECT job_id, CASE WHEN processing_ms < 20 THEN 'ArchiveFailed' WHEN processing_ms < 40 THEN 'NotArchived' ELSE 'Archived' END AS a,
      CASE WHEN processing_ms < 30 THEN 'Pending' ELSE 'Sent' END AS n FROM states WHERE state = 'Succeeded')
    SELECT job_id, 'archive' AS action FROM j WHERE a <> 'Archived' UNION ALL SELECT job_id, 'notification' FROM j WHERE n <> 'Sent'""",
)
def pending_finalization(t: Tables) -> DataFrame:
    ms = F.col("processing_ms")
    work = states(t).withColumns(
        {
            "archive_status": F.when(ms < 20, "ArchiveFailed").when(ms < 40, "NotArchived").otherwise("Archived"),
            "notification_status": F.when(ms < 30, "Pending").otherwise("Sent"),
        }
    )
    return R.pending_finalization(work).select("job_id", "action")


@query(
    "expired",
    f"""WITH {STATES} SELECT job_id, CAST(date_diff('day', CAST(received_at AS DATE), DATE '2024-01-31') AS INTEGER) AS age_days FROM states
    WHERE date_diff('day', CAST(received_at AS DATE), DATE '2024-01-31') > 20""",
)
def expired(t: Tables) -> DataFrame:
    stored = states(t).withColumnRenamed("received_at", "stored_at")
    return R.expired_artifacts(stored, F.lit("2024-01-31").cast("date"), 20, 14).select("job_id", "age_days")


# ---- reports ------------------------------------------------------------


@query(
    "ops_metrics",
    f"""WITH {STATES} SELECT partner, count(*) AS n_jobs, count(*) FILTER (state = 'Queued') AS n_queued, count(*) FILTER (state = 'Running') AS n_running,
      count(*) FILTER (state = 'Succeeded') AS n_succeeded, count(*) FILTER (state = 'Failed') AS n_failed,
      count(*) FILTER (state = 'Duplicate') AS n_duplicate, quantile_disc(processing_ms, 0.5) AS p50_ms, quantile_disc(processing_ms, 0.95) AS p95_ms,
      (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(min(received_at) FILTER (state = 'Queued'))) // 1000000 AS oldest_queue_s
    FROM states GROUP BY partner""",
)
def ops_metrics(t: Tables) -> DataFrame:
    return Q.ops_metrics(states(t), ["partner"], F.lit("2024-02-01").cast("timestamp"), 50.0)


@query(
    "slo_breach",
    f"""WITH {STATES}, w AS (SELECT job_type, epoch_us(received_at) // 86400000000 AS slot, quantile_disc(processing_ms, 0.95) AS p95_ms
      FROM states GROUP BY ALL), b AS (SELECT job_type, avg(processing_ms) * 2.4 AS baseline_ms FROM states GROUP BY job_type),
    o AS (SELECT w.*, p95_ms > 1.2 * baseline_ms AS over FROM w JOIN b USING (job_type)),
    l AS (SELECT *, lag(over) OVER (PARTITION BY job_type ORDER BY slot) AS before FROM o)
    SELECT job_type, slot, p95_ms FROM l WHERE over AND before""",
)
def slo_breach(t: Tables) -> DataFrame:
    base = states(t).groupBy("job_type").agg((F.avg("processing_ms") * 2.4).alias("baseline_ms"))
    return Q.slo_breach(states(t), "job_type", "received_at", 86400, base, 50.0).drop("baseline_ms")


@query(
    "distinct_deliveries",
    """SELECT event_type, count(DISTINCT user_id || '|' || props) AS n_deliveries FROM events GROUP BY event_type""",
)
def distinct_deliveries(t: Tables) -> DataFrame:
    return Q.distinct_deliveries(t.events, ["event_type"], ["user_id", "props"])


@query(
    "coverage",
    """SELECT user_id AS partner, event_type AS job_type, count(*) AS n_runs, count(*) / (SELECT count(*) FROM events) AS share
    FROM events GROUP BY ALL""",
)
def coverage(t: Tables) -> DataFrame:
    return Q.coverage(states(t))


@query(
    "search_jobs",
    f"""WITH {STATES} SELECT job_id, partner, state FROM states WHERE state = 'Failed' AND job_id > 500 ORDER BY job_id LIMIT 50""",
)
def search_jobs(t: Tables) -> DataFrame:
    found = Q.search_jobs(states(t).withColumnRenamed("state", "status"), status="Failed")
    return A.page(found, ["job_id"], [500], 50).select("job_id", "partner", F.col("status").alias("state"))


@query(
    "business_date",
    """SELECT strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d') AS business_date, count(*) AS n FROM events GROUP BY 1""",
)
def business_date(t: Tables) -> DataFrame:
    day = F.date_format(Y.business_date(F.col("ts").cast("timestamp")), "yyyy-MM-dd")
    return t.events.groupBy(day.alias("business_date")).agg(F.count(F.lit(1)).alias("n"))


MASK_SQL = r"""regexp_replace(regexp_replace(regexp_replace(text, '(?i)(password|secret|token|api_key)(\s*[:=]\s*)[^\s]+', '\1\2***', 'g'),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '***@***', 'g'), '[0-9]{6,}', '######', 'g')"""


@query("mask_results", f"SELECT conv_id, turn, {MASK_SQL} AS text FROM conversations")
def mask_results(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", masked(F.col("text")).alias("text"))


@query("mask_documents", f"SELECT doc_id, sha256({MASK_SQL}) AS masked_hash, {MASK_SQL} <> text AS changed FROM documents")
def mask_documents(t: Tables) -> DataFrame:
    text = masked(F.col("text"))
    return spread(t.documents).select("doc_id", Y.content_hash(text).alias("masked_hash"), (text != F.col("text")).alias("changed"))


@query(
    "partner_conversion",
    """SELECT p_partkey, upper(p_name) AS name, regexp_replace(p_brand, '[^0-9]', '', 'g') AS brand_no FROM part""",
)
def partner_conversion(t: Tables) -> DataFrame:
    fn = lambda c, name: U.RULES["convert"](c, name)
    return t.part.select("p_partkey", fn("p_name", "upper_trim").alias("name"), fn("p_brand", "digits_only").alias("brand_no"))


@query(
    "system_id_parts",
    f"""WITH {HEADERS_SQL} SELECT string_split(system_id, '-')[1] AS mode, string_split(system_id, '-')[2] AS type, count(*) AS n FROM headers GROUP BY ALL""",
)
def system_ids(t: Tables) -> DataFrame:
    mode, kind = system_id_parts(F.col("system_id"))
    return headers(t).groupBy(mode.alias("mode"), kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "preview",
    f"""{TYPED}, s AS (SELECT * FROM typed_status ORDER BY source_row_id LIMIT 60)
    SELECT source_row_id, status, 'v_date' AS field, t.order_date AS before, strftime(s.order_date, '%Y-%m-%d') AS after, r_order_date AS reason
      FROM s JOIN order_text t USING (source_row_id)
    UNION ALL SELECT source_row_id, status, 'v_paid', t.is_paid, CAST(s.is_paid AS VARCHAR), r_is_paid FROM s JOIN order_text t USING (source_row_id)""",
)
def preview(t: Tables) -> DataFrame:
    """Before and after of two fields for the first sixty rows (the preview's own limit)."""
    # the status covers all fields, so the other rules run too
    fields = [Field(f.source, f"v_{f.source}", f.kind, f.required, f.format) for f in ORDER_FIELDS]
    shown = N.preview(order_text(t.orders), fields, 60, ["source_row_id"])
    field = F.when(F.col("field") == "v_order_date", "v_date").when(F.col("field") == "v_is_paid", "v_paid")
    return shown.filter(F.col("field").isin("v_order_date", "v_is_paid")).select(
        "source_row_id", "status", field.alias("field"), "before", "after", "reason"
    )
