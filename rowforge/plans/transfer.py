"""Queries: legacy conversions, mapping to several targets, checks, headers and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.functions import checks as K
from rowforge.functions import convert as C
from rowforge.functions import rules as U
from rowforge.functions.text import strip_quotes, with_trimmed
from rowforge.operators import lookup as J
from rowforge.operators import normalize as N
from rowforge.operators import transfer as X
from rowforge.plans.catalog import Tables, query
from rowforge.plans.core import ERROR_ARMS, TYPED, results
from rowforge.session import spread

ROW = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
ROW_SQL = ", ".join(ROW)
LINE_SQL = """line_text AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS flag, l_linestatus AS line_status,
  CASE WHEN l_partkey % 97 = 0 THEN 'abc' WHEN l_partkey % 61 = 0 THEN ' '
       ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.00' END AS qty,
  CASE WHEN l_partkey % 178 = 0 THEN '12,345,678,901.00' WHEN l_partkey % 89 = 0 THEN '12345678901.00' ELSE format('{:,.2f}', CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS DOUBLE)) END AS price,
  CASE WHEN l_suppkey % 13 = 0 THEN '31/02/2026' WHEN l_partkey % 50 = 0 THEN '' ELSE strftime(l_shipdate, '%d/%m/%Y') END AS ship,
  CASE WHEN l_partkey % 83 = 0 THEN 'not-a-guid' ELSE '6F9619FF-8B86-D011-B42D-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') END AS guid,
  'O''Neil "' || l_returnflag || '"' AS agent FROM lineitem)"""


def line_text(t: Tables) -> DataFrame:
    """Line items as staging rows, every field text."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return spread(t.lineitem).select(
        *ROW, F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"),
        F.when(part % 97 == 0, "abc").when(part % 61 == 0, " ")
        .otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".00"))).alias("qty"),
        F.when(part % 178 == 0, "12,345,678,901.00").when(part % 89 == 0, "12345678901.00")
        .otherwise(F.format_number(F.col("l_extendedprice").cast("decimal(15,2)"), 2)).alias("price"),
        F.when(supp % 13 == 0, "31/02/2026").when(part % 50 == 0, "").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("ship"),
        F.when(part % 83 == 0, "not-a-guid")
        .otherwise(F.concat(F.lit("6F9619FF-8B86-D011-B42D-"), F.lpad(part.cast("string"), 12, "0"))).alias("guid"),
        F.concat(F.lit("O'Neil \""), F.col("l_returnflag"), F.lit('"')).alias("agent"),
    )


TYPED_LINE = f"""WITH {LINE_SQL}, line_value AS (SELECT *,
  CASE WHEN regexp_matches(replace(replace(trim(qty), ',', ''), '.00', ''), '^[+-]?[0-9]+$')
       THEN TRY_CAST(replace(replace(trim(qty), ',', ''), '.00', '') AS INTEGER) END AS n_qty,
  CASE WHEN regexp_matches(replace(price, ',', ''), '^[+-]?[0-9]+[.][0-9]+$') THEN TRY_CAST(replace(price, ',', '') AS DECIMAL(12,2)) END AS n_price,
  CAST(try_strptime(nullif(ship, ''), '%d/%m/%Y') AS DATE) AS n_ship,
  CASE WHEN regexp_matches(lower(guid), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN lower(guid) END AS n_guid
  FROM line_text),
line_ok AS (SELECT *, (trim(qty) = '' OR n_qty IS NOT NULL) AND n_price IS NOT NULL AND (ship = '' OR n_ship IS NOT NULL) AS ok_original,
  n_guid IS NOT NULL AS ok_car FROM line_value)"""


@query(
    "legacy_conversions",
    f"""{TYPED_LINE} SELECT {ROW_SQL}, n_qty AS qty, CAST(n_price AS DOUBLE) AS price, strftime(n_ship, '%Y-%m-%d') AS ship,
      n_guid AS guid FROM line_value""",
)
def legacy_conversions(t: Tables) -> DataFrame:
    typed = with_trimmed(line_text(t), ["qty", "price", "ship", "guid"]).select(
        *ROW, C.legacy_int(F.col("_t_qty")).alias("qty"), C.legacy_decimal(F.col("_t_price")).cast("double").alias("price"),
        C.legacy_date(F.col("_t_ship")).alias("ship"), C.to_uuid(F.col("_t_guid")).alias("guid"),
    )
    return typed.withColumn("ship", F.date_format("ship", "yyyy-MM-dd"))


ORIGINAL = U.TargetMap(
    "original", 1,
    (
        U.ColumnMap("nQty", "qty", "INT", "0"), U.ColumnMap("nPrice", "price", "DECIMAL"), U.ColumnMap("dShip", "ship", "DATE"),
        U.ColumnMap("cSTATUS", default="I"), U.ColumnMap("cFlag", "flag"), U.ColumnMap("cAgent", "agent"),
        U.ColumnMap("cCode", "guid"), U.ColumnMap("cKey", "flag"), U.ColumnMap("cTail", "guid"), U.ColumnMap("cMask", "guid"),
    ),
    (
        U.Condition("cFlag", 2, "substring", ("flag", 1, 1)), U.Condition("cFlag", 1, "iif", ("flag", "eq", "R", "RETURN", "KEEP")),
        U.Condition("cAgent", 1, "replace", ("agent", '"', "")), U.Condition("cCode", 1, "substring", ("guid", 1, 8)),
        U.Condition("cKey", 1, "concat", ("flag", "line_status", "ship")), U.Condition("cTail", 1, "split", ("guid", "-", 5)),
        U.Condition("cMask", 1, "stuff", ("guid", 1, 3, "***")),
    ),
)
CLIENT = U.TargetMap(
    "original_client", 2, (U.ColumnMap("cAgent", "agent"), U.ColumnMap("cKind", "line_status")),
    where=(U.Predicate("flag", "in", ("A", "R")),),
)
CAR = U.TargetMap("original_cardetail", 3, (U.ColumnMap("cGuid", "guid", "UNIQUEIDENTIFIER"), U.ColumnMap("nQty", "qty")))
TARGETS = [CAR, ORIGINAL, CLIENT]

OPS = f"""{TYPED_LINE}, ops AS (
  SELECT {ROW_SQL}, 'original' AS target_id, 1 AS sequence, 'PRIMARY' AS operation_type,
    CASE WHEN ok_original THEN 'Succeeded' ELSE 'Failed' END AS result FROM line_ok
  UNION ALL SELECT {ROW_SQL}, 'original_client', 2, 'PRIMARY', 'Succeeded' FROM line_ok WHERE flag IN ('A', 'R')
  UNION ALL SELECT {ROW_SQL}, 'original_cardetail', 3, 'PRIMARY', CASE WHEN ok_car THEN 'Succeeded' ELSE 'Failed' END FROM line_ok)"""


@query(
    "legacy_mapping",
    f"""{TYPED_LINE} SELECT {ROW_SQL}, coalesce(n_qty, 0) AS "nQty", CAST(n_price AS DOUBLE) AS "nPrice",
      strftime(n_ship, '%Y-%m-%d') AS "dShip", 'I' AS "cSTATUS", CASE WHEN flag = 'R' THEN 'RETURN' ELSE 'KEEP' END AS "cFlag",
      'O''Neil ' || flag AS "cAgent", substring(guid, 1, 8) AS "cCode", flag || line_status || ship AS "cKey",
      coalesce(string_split(guid, '-')[5], '') AS "cTail", '***' || substring(guid, 4) AS "cMask"
    FROM line_ok WHERE ok_original""",
)
def legacy_mapping(t: Tables) -> DataFrame:
    out = X.fan_out(line_text(t), TARGETS, ROW)["original"]
    return out.withColumns({"nPrice": F.col("nPrice").cast("double"), "dShip": F.date_format("dShip", "yyyy-MM-dd")})


STAMPED = U.TargetMap(
    "stamped", 1, (U.ColumnMap("dCreated", type="DATETIME", default="now"), U.ColumnMap("dDay", type="DATETIME", default="today"), U.ColumnMap("cFlag", "flag")),
)


@query("legacy_datetime_default", f"{TYPED_LINE} SELECT {ROW_SQL}, flag AS \"cFlag\", TRUE AS stamped, TRUE AS dated FROM line_ok")
def legacy_datetime_default(t: Tables) -> DataFrame:
    """DATETIME defaults name an allowed expression; every row of a run gets the same time."""
    out = X.fan_out(line_text(t), (STAMPED,), ROW)["stamped"]
    fresh = F.col("dCreated").cast("timestamp").between(F.current_timestamp() - F.expr("INTERVAL 1 HOUR"), F.current_timestamp())
    return out.select(*ROW, "cFlag", fresh.alias("stamped"), (F.col("dDay").cast("date") == F.current_date()).alias("dated"))


@query("fan_out_targets", f"{OPS} SELECT * FROM ops")
def fan_out_targets(t: Tables) -> DataFrame:
    return X.operations(line_text(t), TARGETS, ROW)


@query(
    "union_ops",
    f"""{TYPED_LINE} SELECT {ROW_SQL}, 'original' AS target_id, 1 AS sequence, 'PRIMARY' AS operation_type,
      CASE WHEN ok_original THEN 'Succeeded' ELSE 'Failed' END AS result FROM line_ok
    UNION ALL SELECT {ROW_SQL}, 'original', 2, 'UNION', CASE WHEN trim(qty) = '' OR n_qty IS NOT NULL THEN 'Succeeded' ELSE 'Failed' END
      FROM line_ok WHERE line_status = 'O'""",
)
def union_ops(t: Tables) -> DataFrame:
    second = U.TargetMap("original", 2, (U.ColumnMap("nQty", "qty", "INT"),), where=(U.Predicate("line_status", "eq", "O"),))
    return X.with_union(line_text(t), ORIGINAL, second, ROW)


def reported(t: Tables) -> DataFrame:
    """Operations as recorded: the car target's answer is unknown for one flag and part group."""
    unclear = (F.col("target_id") == "original_cardetail") & (F.col("l_partkey") % 71 == 0)
    ops = X.operations(line_text(t), TARGETS, ROW)
    result = F.when(unclear, X.UNKNOWN).otherwise(F.col("result"))
    return ops.withColumns(
        {"result": result, "required": F.col("target_id") != "original_client",
         "affected_rows": F.when(result == X.SUCCEEDED, 1).when(result == X.FAILED, 0)}
    )


REPORTED = f"""{OPS}, reported AS (SELECT * EXCLUDE (result),
  CASE WHEN target_id = 'original_cardetail' AND l_partkey % 71 = 0 THEN 'Unknown' ELSE result END AS result FROM ops)"""


@query(
    "job_state",
    f"""{REPORTED}, needed AS (SELECT *, target_id <> 'original_client' AND l_orderkey % 17 <> 0 AS required FROM reported)
    SELECT l_orderkey, CASE WHEN count(*) FILTER (required AND result = 'Unknown') > 0 THEN 'NeedsReview'
      WHEN count(*) FILTER (required AND result <> 'Succeeded') = 0 THEN 'Succeeded'
      WHEN count(*) FILTER (required AND result = 'Succeeded') > 0 THEN 'PartiallySucceeded'
      ELSE 'Failed' END AS state FROM needed GROUP BY l_orderkey""",
)
def job_state(t: Tables) -> DataFrame:
    """Jobs of every seventeenth order have no required operation and are listed all the same."""
    ops = reported(t)
    return X.job_state(ops.withColumn("required", F.col("required") & (F.col("l_orderkey") % 17 != 0)), "l_orderkey")


@query(
    "job_counts",
    f"""{REPORTED}, per_row AS (SELECT {ROW_SQL}, count(*) AS n, count(*) FILTER (result = 'Succeeded') AS ok,
      count(*) FILTER (result = 'Failed') AS bad,
      sum(CASE result WHEN 'Succeeded' THEN 1 WHEN 'Failed' THEN 0 END) AS written FROM reported GROUP BY ALL)
    SELECT l_orderkey, count(*) AS input_rows, count(*) FILTER (ok = n) AS completed_rows, count(*) FILTER (bad > 0) AS failed_rows,
      CAST(sum(n) AS BIGINT) AS expected_operations, CAST(sum(ok) AS BIGINT) AS succeeded_operations,
      CAST(sum(bad) AS BIGINT) AS failed_operations, CAST(sum(written) AS BIGINT) AS rows_written FROM per_row GROUP BY l_orderkey""",
)
def job_counts(t: Tables) -> DataFrame:
    return X.job_counts(reported(t), "l_orderkey", list(ROW[1:]))


HEADERS_SQL = """headers AS (SELECT o_orderkey AS trans_id,
  CASE o_custkey % 3 WHEN 0 THEN 'AY-01' WHEN 1 THEN 'KK-02' ELSE 'TIB-07' END AS system_id,
  'file_' || o_custkey AS ref_no, CASE o_orderstatus WHEN 'F' THEN 'I' WHEN 'O' THEN 'A' ELSE 'E' END AS stat_flag,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Y' WHEN o_orderpriority = '5-LOW' THEN 'N' END AS exp_flag FROM orders)"""


def headers(t: Tables) -> DataFrame:
    """Orders as transaction headers."""
    k = F.col("o_custkey") % 3
    return t.orders.select(
        F.col("o_orderkey").alias("trans_id"), F.when(k == 0, "AY-01").when(k == 1, "KK-02").otherwise("TIB-07").alias("system_id"),
        F.concat(F.lit("file_"), F.col("o_custkey").cast("string")).alias("ref_no"),
        F.when(F.col("o_orderstatus") == "F", "I").when(F.col("o_orderstatus") == "O", "A").otherwise("E").alias("stat_flag"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Y").when(F.col("o_orderpriority") == "5-LOW", "N").alias("exp_flag"),
    )


@query(
    "close_headers",
    f"""{OPS}, {HEADERS_SQL}, told AS (SELECT * FROM ops WHERE NOT (target_id = 'original_cardetail' AND l_orderkey % 19 = 0)),
    due AS (SELECT l_orderkey AS trans_id, count(*) + count(*) FILTER (flag IN ('A', 'R')) + count(*) AS n FROM line_text GROUP BY l_orderkey),
    done AS (SELECT l_orderkey AS trans_id, count(*) AS n_told, bool_and(result = 'Succeeded') AS ok FROM told GROUP BY l_orderkey)
    SELECT trans_id, system_id, CASE WHEN stat_flag = 'I' AND n_told = n THEN CASE WHEN ok THEN 'A' ELSE 'E' END ELSE stat_flag END AS stat_flag
    FROM headers LEFT JOIN due USING (trans_id) LEFT JOIN done USING (trans_id)""",
)
def close_headers(t: Tables) -> DataFrame:
    """Headers without a row for the client target close with the others; those the car target is silent on stay open."""
    rows = line_text(t)
    ops = X.operations(rows, TARGETS, ROW).withColumnRenamed("l_orderkey", "trans_id")
    told = ops.filter(~((F.col("target_id") == "original_cardetail") & (F.col("trans_id") % 19 == 0)))
    return X.close_headers(headers(t), told, X.selected_rows(rows, TARGETS, "l_orderkey")).select("trans_id", "system_id", "stat_flag")


@query(
    "client_rows",
    f"""{TYPED_LINE} SELECT {ROW_SQL}, agent AS "cAgent", line_status AS "cKind" FROM line_ok WHERE flag IN ('A', 'R')""",
)
def client_rows(t: Tables) -> DataFrame:
    """The rows of the filtered second target."""
    return X.fan_out(line_text(t), TARGETS, ROW)["original_client"]


@query(
    "cardetail_rows",
    f"""{TYPED_LINE} SELECT {ROW_SQL}, n_guid AS "cGuid", trim(qty) AS "nQty" FROM line_ok WHERE ok_car""",
)
def cardetail_rows(t: Tables) -> DataFrame:
    """The rows of the third target; its quantity stays text."""
    return X.fan_out(line_text(t), TARGETS, ROW)["original_cardetail"]


@query(
    "pending_headers",
    f"""WITH {HEADERS_SQL} SELECT 'AY' AS mode, trans_id, system_id FROM headers WHERE stat_flag = 'I' AND contains(system_id, 'AY-0')
    UNION ALL SELECT 'TIB', trans_id, system_id FROM headers WHERE stat_flag = 'I' AND contains(system_id, 'TIB-')""",
)
def pending_headers(t: Tables) -> DataFrame:
    pick = lambda m: X.pending_headers(headers(t), m).select(F.lit(m).alias("mode"), "trans_id", "system_id")
    return pick("AY").unionByName(pick("TIB"))


@query(
    "row_selection",
    f"""WITH {HEADERS_SQL}, {LINE_SQL} SELECT {ROW_SQL}, flag FROM line_text
    WHERE flag IN ('A', 'N') AND trim(ship) <> '' AND qty <> 'abc'
      AND l_orderkey IN (SELECT trans_id FROM headers WHERE stat_flag = 'I')""",
)
def row_selection(t: Tables) -> DataFrame:
    where = [U.Predicate("flag", "in", ("A", "N")), U.Predicate("ship", "not_blank"), U.Predicate("qty", "ne", "abc")]
    open_ = headers(t).filter("stat_flag = 'I'")
    rows = line_text(t).withColumn("trans_id", F.col("l_orderkey"))
    return X.row_selection(rows, open_, where).select(*ROW, "flag")


@query(
    "row_number_rule",
    f"""WITH {HEADERS_SQL}, {LINE_SQL} SELECT {ROW_SQL}, flag FROM line_text
    WHERE l_linenumber <= 2 AND l_orderkey IN (SELECT trans_id FROM headers WHERE stat_flag = 'I')""",
)
def row_number_rule(t: Tables) -> DataFrame:
    """A rule on the row number replaces all others of the selection."""
    where = [U.Predicate("flag", "eq", "A"), U.Predicate("row_number", "le", 2), U.Predicate("qty", "blank")]
    rows = line_text(t).withColumns({"trans_id": F.col("l_orderkey"), "row_number": F.col("l_linenumber")})
    return X.row_selection(rows, headers(t).filter("stat_flag = 'I'"), where).select(*ROW, "flag")


@query(
    "legacy_times",
    f"""{TYPED_LINE} SELECT {ROW_SQL}, strftime(CAST(n_ship AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS shipped_at, 'ONeil ' || flag AS agent FROM line_value""",
)
def legacy_times(t: Tables) -> DataFrame:
    """Dates of the old style as timestamps, and texts without quotes and apostrophes."""
    at = F.date_format(C.legacy_timestamp(F.col("ship")), "yyyy-MM-dd HH:mm:ss")
    return line_text(t).select(*ROW, at.alias("shipped_at"), strip_quotes(F.col("agent")).alias("agent"))


CONFIG_SQL = """static_info AS (SELECT p_partkey, CASE WHEN p_size > 3 THEN 'MAPOR' ELSE 'TIMER' END AS grp,
  CASE p_type WHEN 'ECONOMY' THEN 'AY' WHEN 'PROMO' THEN 'TQM' ELSE 'KK' END AS desc1,
  lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') AS desc5, CASE WHEN p_size % 4 = 0 THEN 'I' ELSE 'A' END AS stat_flag FROM part)"""


@query(
    "job_configs",
    f"""WITH {CONFIG_SQL} SELECT p_partkey, desc1, desc5 FROM static_info WHERE grp = 'MAPOR' AND stat_flag = 'A'
      AND (desc1 = 'KK' OR (desc1 IN ('AY', 'TQM') AND (CAST(desc5 AS INTEGER) BETWEEN 1 AND 10 OR CAST(desc5 AS INTEGER) BETWEEN 51 AND 55)))""",
)
def job_configs(t: Tables) -> DataFrame:
    size, kind = F.col("p_size"), F.col("p_type")
    info = t.part.select(
        "p_partkey", F.when(size > 3, "MAPOR").otherwise("TIMER").alias("grp"),
        F.when(kind == "ECONOMY", "AY").when(kind == "PROMO", "TQM").otherwise("KK").alias("desc1"),
        F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0").alias("desc5"), F.when(size % 4 == 0, "I").otherwise("A").alias("stat_flag"),
    )
    out = X.active_jobs(info, "kk")
    for mode in ("AY", "TQM"):
        out = out.unionByName(X.active_jobs(info, mode))
    return out.select("p_partkey", "desc1", "desc5")


@query(
    "first_conditions",
    """SELECT p_brand AS map_id, p_name AS target_column, min(p_partkey) AS sequence, arg_min(p_type, p_partkey) AS rule FROM part GROUP BY ALL""",
)
def first_conditions(t: Tables) -> DataFrame:
    rules = t.part.select(
        F.col("p_brand").alias("map_id"), F.col("p_name").alias("target_column"), F.col("p_partkey").alias("sequence"),
        F.col("p_type").alias("rule"),
    )
    return X.first_condition(rules)


@query(
    "resolve_headers",
    """WITH d AS (SELECT DISTINCT 'KK-' || l_linestatus AS system_id, l_suppkey AS ref_no, l_returnflag AS sub_ref_no FROM lineitem),
    h AS (SELECT 'KK-O' AS system_id, s_suppkey AS ref_no, 'A' AS sub_ref_no, 'T' || s_suppkey AS trans_id FROM supplier)
    SELECT d.*, coalesce(h.trans_id, sha256('4:' || d.system_id || '|' || length(CAST(d.ref_no AS VARCHAR)) || ':' || d.ref_no || '|1:' || d.sub_ref_no)) AS trans_id,
      h.trans_id IS NULL AS is_new FROM d LEFT JOIN h USING (system_id, ref_no, sub_ref_no)""",
)
def resolve_headers(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.concat(F.lit("KK-"), F.col("l_linestatus")).alias("system_id"), F.col("l_suppkey").alias("ref_no"),
        F.col("l_returnflag").alias("sub_ref_no"),
    )
    known = t.supplier.select(
        F.lit("KK-O").alias("system_id"), F.col("s_suppkey").alias("ref_no"), F.lit("A").alias("sub_ref_no"),
        F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("trans_id"),
    )
    return X.resolve_headers(rows, known)


# ---- checks -------------------------------------------------------------


def checked(t: Tables) -> DataFrame:
    """Staging rows with the answers of the reference and uniqueness checks."""
    rows = line_text(t)
    nations = t.part.filter(F.col("p_size") > 3)
    flagged = J.with_duplicate_flag(rows, ["l_orderkey", "l_linenumber"], "twice")
    return J.with_missing_flag(flagged, nations, "l_partkey", "p_partkey", "no_part")


def checks() -> list[K.Check]:
    return [
        K.required("qty"), K.max_len("price", 12), K.convertible("ship", C.legacy_date),
        K.convertible("guid", C.to_uuid), K.fits("price", 12, 2), K.check("flag", F.col("flag") != "N"),
        K.flagged("l_partkey", "NoReference", 547, "no_part"), K.flagged("l_linenumber", "DuplicateKey", 2627, "twice"),
    ]


VIOLATIONS = f"""{TYPED_LINE}, dup AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1),
found AS (
  SELECT {ROW_SQL}, 'qty' AS field, 'Required' AS reason, 515 AS number FROM line_value WHERE trim(qty) = ''
  UNION ALL SELECT {ROW_SQL}, 'price', 'TooLong', 2628 FROM line_value WHERE length(price) > 12
  UNION ALL SELECT {ROW_SQL}, 'ship', 'NotConvertible', 241 FROM line_value WHERE ship <> '' AND n_ship IS NULL
  UNION ALL SELECT {ROW_SQL}, 'guid', 'NotConvertible', 241 FROM line_value WHERE n_guid IS NULL
  UNION ALL SELECT {ROW_SQL}, 'price', 'Overflow', 8115 FROM line_value WHERE price IN ('12345678901.00', '12,345,678,901.00')
  UNION ALL SELECT {ROW_SQL}, 'flag', 'CheckFailed', 547 FROM line_value WHERE flag = 'N'
  UNION ALL SELECT {ROW_SQL}, 'l_partkey', 'NoReference', 547 FROM line_value
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)
  UNION ALL SELECT {ROW_SQL}, 'l_linenumber', 'DuplicateKey', 2627 FROM line_value
    WHERE (l_orderkey, l_linenumber) IN (SELECT * FROM dup))"""


@query("violations", f"{VIOLATIONS} SELECT *, 'partner' AS category FROM found")
def violations(t: Tables) -> DataFrame:
    return K.violations(checked(t), list(ROW), checks())


@query(
    "lookup_missing",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""",
)
def lookup_missing(t: Tables) -> DataFrame:
    ref = t.customer.filter(F.col("c_mktsegment") != "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return J.lookup(t.orders, ref, ["o_custkey"], "missing").select("o_orderkey", "o_custkey")


@query(
    "lookup_attach",
    """SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def lookup_attach(t: Tables) -> DataFrame:
    ref = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    with_customer = J.lookup(t.orders.select("o_orderkey", "o_custkey"), ref, ["o_custkey"])
    return J.lookup(with_customer, t.nation, ["n_nationkey"]).select("o_orderkey", "c_mktsegment", "n_name")


@query(
    "fk_violations",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'NoReference' AS reason FROM lineitem
    WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""",
)
def fk_violations(t: Tables) -> DataFrame:
    active = t.supplier.filter(F.col("s_acctbal") > 5000)
    flagged = J.with_missing_flag(t.lineitem.select(*ROW), active, "l_suppkey", "s_suppkey", "no_supplier")
    return K.violations(flagged, list(ROW), [K.flagged("l_suppkey", "NoReference", 547, "no_supplier")]).select(*ROW, "reason")


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_batch, l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
      AND l_linenumber = 1 AS in_target FROM lineitem GROUP BY l_orderkey, l_linenumber
    HAVING count(*) > 1 OR (l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND l_linenumber = 1)""",
)
def duplicate_keys(t: Tables) -> DataFrame:
    target = t.orders.filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return J.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"], target)


@query(
    "collisions",
    """SELECT l_linenumber + l_suppkey * 10 AS row_number, count(DISTINCT l_orderkey) AS n_trans FROM lineitem
    GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1""",
)
def collisions(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_linenumber") + F.col("l_suppkey") * 10).alias("row_number"), F.col("l_orderkey").alias("trans_id"))
    return X.collisions(rows)


@query(
    "categorize",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, number,
      CASE WHEN number IN (2628, 8152, 241, 245, 8114, 8115, 515, 547, 2627, 2601) THEN 'partner' ELSE 'system' END AS category
    FROM (SELECT *, CASE l_linenumber WHEN 1 THEN 2627 WHEN 2 THEN 1205 WHEN 3 THEN 8115 WHEN 4 THEN 0 ELSE 547 END AS number FROM lineitem)""",
)
def categorize(t: Tables) -> DataFrame:
    from rowforge.functions.text import error_category

    n = F.col("l_linenumber")
    number = F.when(n == 1, 2627).when(n == 2, 1205).when(n == 3, 8115).when(n == 4, 0).otherwise(547)
    return t.lineitem.select(*ROW, number.alias("number"), error_category(number).alias("category"))


# ---- reconciliation and notification -------------------------------------

RECONCILED = f"""{TYPED}, c AS (SELECT file_job_id, count(*) AS n, count(*) FILTER (status = 'Done') AS ok,
  count(*) FILTER (status <> 'Done') AS bad FROM typed_status GROUP BY file_job_id),
steps AS (SELECT file_job_id, 1 AS step_no, n AS count_source, CAST(NULL AS BIGINT) AS count_destination, CAST(NULL AS BIGINT) AS count_error, 'A' AS status_flag FROM c
  UNION ALL SELECT file_job_id, 2, NULL, ok, NULL, 'A' FROM c
  UNION ALL SELECT file_job_id, 3, NULL, NULL, bad, CASE WHEN bad > 0 THEN 'E' ELSE 'A' END FROM c)"""


@query("reconcile_steps", f"{RECONCILED} SELECT * FROM steps")
def reconcile_steps(t: Tables) -> DataFrame:
    return X.reconcile(results(t), ["file_job_id"])


@query(
    "reconcile_log",
    f"""{RECONCILED}, stored AS (SELECT c_custkey AS file_job_id, 3 AS step_no, CAST(NULL AS BIGINT) AS count_source,
      CAST(NULL AS BIGINT) AS count_destination, CAST(99 AS BIGINT) AS count_error, 'E' AS status_flag FROM customer)
    SELECT * FROM steps UNION ALL SELECT * FROM stored WHERE (file_job_id, step_no) NOT IN (SELECT file_job_id, step_no FROM steps)""",
)
def reconcile_log(t: Tables) -> DataFrame:
    """Older error steps are found again and replaced; files without new results keep theirs."""
    none = F.lit(None).cast("bigint")
    stored = t.customer.select(
        F.col("c_custkey").alias("file_job_id"), F.lit(3).alias("step_no"), none.alias("count_source"),
        none.alias("count_destination"), F.lit(99).cast("bigint").alias("count_error"), F.lit("E").alias("status_flag"),
    )
    return X.reconcile_log(stored, X.reconcile(results(t), ["file_job_id"]), ["file_job_id"])


@query(
    "error_summary",
    f"""{TYPED}, errs AS ({ERROR_ARMS}) SELECT file_job_id, field, reason, count(*) AS n_errors, min(row_number) AS first_row
    FROM errs GROUP BY ALL""",
)
def error_summary(t: Tables) -> DataFrame:
    return X.error_summary(N.row_errors(results(t)), ["file_job_id"])


@query(
    "notification_summary",
    f"""{VIOLATIONS}, kinds AS (SELECT l_suppkey, field, reason, count(*) AS n FROM found GROUP BY ALL),
    errs AS (SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS partner_errors,
      string_agg(field || ':' || reason || ':' || n, '; ' ORDER BY field || ':' || reason || ':' || n) AS partner_detail FROM kinds GROUP BY l_suppkey)
    SELECT l_suppkey, count(*) AS n_rows, coalesce(any_value(partner_errors), 0) AS partner_errors, CAST(0 AS BIGINT) AS system_errors,
      coalesce(any_value(partner_detail), '') AS partner_detail,
      CASE WHEN any_value(partner_errors) IS NULL THEN 'SUCCESS' ELSE 'ERROR' END AS subject
    FROM lineitem LEFT JOIN errs USING (l_suppkey) GROUP BY l_suppkey""",
)
def notification_summary(t: Tables) -> DataFrame:
    totals = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_rows"))
    return X.notification_summary(K.violations(checked(t), list(ROW), checks()), totals, "l_suppkey")


@query(
    "notification_system_errors",
    """WITH v AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'system' ELSE 'partner' END AS category, event_type AS field,
        CASE WHEN value >= 50 THEN 'High' ELSE 'Low' END AS reason FROM events WHERE event_type IN ('error', 'view')),
    kinds AS (SELECT user_id, category, field, reason, count(*) AS n FROM v GROUP BY ALL),
    errs AS (SELECT user_id, CAST(coalesce(sum(n) FILTER (category = 'partner'), 0) AS BIGINT) AS partner_errors,
      CAST(coalesce(sum(n) FILTER (category = 'system'), 0) AS BIGINT) AS system_errors,
      coalesce(string_agg(field || ':' || reason || ':' || n, '; ' ORDER BY field || ':' || reason || ':' || n) FILTER (category = 'partner'), '') AS partner_detail FROM kinds GROUP BY user_id),
    totals AS (SELECT user_id, count(*) AS n_rows FROM events GROUP BY user_id)
    SELECT user_id, n_rows, coalesce(partner_errors, 0) AS partner_errors, coalesce(system_errors, 0) AS system_errors, coalesce(partner_detail, '') AS partner_detail,
      CASE WHEN coalesce(partner_errors, 0) + coalesce(system_errors, 0) = 0 THEN 'SUCCESS' ELSE 'ERROR' END AS subject
    FROM totals LEFT JOIN errs USING (user_id)""",
)
def notification_system_errors(t: Tables) -> DataFrame:
    """Notifications where the system itself failed: only partner errors are listed, both count."""
    category = F.when(F.col("event_type") == "error", "system").otherwise("partner")
    reason = F.when(F.col("value") >= 50, "High").otherwise("Low")
    found = t.events.where(F.col("event_type").isin("error", "view")).select("user_id", category.alias("category"), F.col("event_type").alias("field"), reason.alias("reason"))
    return X.notification_summary(found, t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows")), "user_id")
