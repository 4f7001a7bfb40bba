"""The test tables seen as partner deliveries, in Spark and in SQL.

Faults depend on the key alone, so both engines render the same text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.convert import Field
from rowforge.session import spread


def money(c: Column) -> Column:
    return c.cast("decimal(15,2)").cast("string")


def order_text(orders: DataFrame) -> DataFrame:
    """Orders as Source rows: customer is the file, everything else text with faults."""
    k = F.col("o_orderkey")
    return spread(orders).select(
        k.alias("source_row_id"),
        F.col("o_custkey").alias("file_job_id"),
        k.alias("row_number"),
        k.cast("string").alias("order_no"),
        F.when(k % 90 == 0, F.lit(" \t "))
        .otherwise(F.concat(F.lit("\t Customer "), F.col("o_custkey").cast("string"), F.lit("  ")))
        .alias("customer_name"),
        F.when(k % 50 == 0, "2026-02-30")
        .when(k % 51 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(k % 53 == 0, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-1-5")))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("order_date"),
        F.when(k % 70 == 0, "1,234.50")
        .when(k % 130 == 0, "1e3")
        .when(k % 170 == 0, "1234567890123456789012345678901")
        .otherwise(money(F.col("o_totalprice")))
        .alias("amount"),
        F.when(k % 110 == 0, "yes").when(F.col("o_orderstatus") == "F", "TRUE").otherwise("0").alias("is_paid"),
        F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("note"),
    )


ORDER_TEXT_SQL = """
order_text AS (
  SELECT o_orderkey AS source_row_id, o_custkey AS file_job_id, o_orderkey AS row_number,
    CAST(o_orderkey AS VARCHAR) AS order_no,
    CASE WHEN o_orderkey % 90 = 0 THEN ' ' || chr(9) || ' '
         ELSE chr(9) || ' Customer ' || CAST(o_custkey AS VARCHAR) || '  ' END AS customer_name,
    CASE WHEN o_orderkey % 50 = 0 THEN '2026-02-30'
         WHEN o_orderkey % 51 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
         WHEN o_orderkey % 53 = 0 THEN strftime(o_orderdate, '%Y') || '-1-5'
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
    CASE WHEN o_orderkey % 70 = 0 THEN '1,234.50'
         WHEN o_orderkey % 130 = 0 THEN '1e3'
         WHEN o_orderkey % 170 = 0 THEN '1234567890123456789012345678901'
         ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END AS amount,
    CASE WHEN o_orderkey % 110 = 0 THEN 'yes' WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE '0' END AS is_paid,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS note
  FROM orders)"""

ORDER_FIELDS = [
    Field("order_no", "order_no", "text", required=True),
    Field("customer_name", "customer_name", "text", required=True),
    Field("order_date", "order_date", "date", required=True),
    Field("amount", "amount", "decimal", required=True),
    Field("is_paid", "is_paid", "boolean", required=True),
    Field("note", "note", "text"),
]


def typed_sql(fmt: str = "%Y-%m-%d", shape: str = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", name: str = "typed") -> str:
    """CTE with one reason column per field of the orders mapping."""
    return f"""
{name}_raw AS (
  SELECT source_row_id, file_job_id, row_number,
    nullif(trim(order_no, chr(9) || ' '), '') AS order_no,
    nullif(trim(customer_name, chr(9) || ' '), '') AS customer_name,
    nullif(trim(order_date), '') AS order_date_text, nullif(trim(amount), '') AS amount_text,
    nullif(trim(is_paid), '') AS is_paid_text, nullif(trim(note), '') AS note
  FROM order_text),
{name}_value AS (
  SELECT *,
    CASE WHEN regexp_matches(order_date_text, '{shape}')
         THEN CAST(try_strptime(order_date_text, '{fmt}') AS DATE) END AS order_date,
    CASE WHEN regexp_matches(amount_text, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$')
         THEN TRY_CAST(amount_text AS DECIMAL(38,10)) END AS amount,
    CASE WHEN lower(is_paid_text) IN ('true', '1') THEN TRUE
         WHEN lower(is_paid_text) IN ('false', '0') THEN FALSE END AS is_paid
  FROM {name}_raw),
{name} AS (
  SELECT *,
    CASE WHEN order_no IS NULL THEN 'Required' END AS r_order_no,
    CASE WHEN customer_name IS NULL THEN 'Required' END AS r_customer_name,
    CASE WHEN order_date_text IS NULL THEN 'Required' WHEN order_date IS NULL THEN 'InvalidDate' END AS r_order_date,
    CASE WHEN amount_text IS NULL THEN 'Required'
         WHEN amount IS NULL AND regexp_matches(amount_text, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN 'Overflow'
         WHEN amount IS NULL THEN 'InvalidDecimal' END AS r_amount,
    CASE WHEN is_paid_text IS NULL THEN 'Required' WHEN is_paid IS NULL THEN 'InvalidBoolean' END AS r_is_paid
  FROM {name}_value),
{name}_status AS (
  SELECT *, CASE WHEN coalesce(r_order_no, r_customer_name, r_order_date, r_amount, r_is_paid) IS NULL
                 THEN 'Done' ELSE 'Invalid' END AS status FROM {name})"""


def day_text(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def amount_number(name: str) -> Column:
    return F.col(name).cast("decimal(15,2)").cast("double").alias(name)
