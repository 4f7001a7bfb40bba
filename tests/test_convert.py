"""Conversion vectors of the mapping rules."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowforge.functions import convert as C
from rowforge.functions import keys, rules, text
from rowforge.operators.normalize import normalize


def one(spark, raw, kind, **kw):
    field = C.Field("raw", "value", kind, **kw)
    df = spark.createDataFrame([(1, raw)], "id int, raw string")
    row = normalize(df, [field], ("id",)).first()
    return row.value, [e.reason for e in row.errors], row.status


@pytest.mark.parametrize(
    "kind, raw, kw, value",
    [
        ("text", "  A ", {}, "A"),
        ("text", "\t A　 ", {}, "A"),
        ("date", "2026-01-31", {}, dt.date(2026, 1, 31)),
        ("date", "31/01/2026", {"format": "dd/MM/yyyy"}, dt.date(2026, 1, 31)),
        ("date", "20260131", {"format": "yyyyMMdd"}, dt.date(2026, 1, 31)),
        ("decimal", "1234.50", {}, Decimal("1234.5")),
        ("decimal", "-3", {}, Decimal(-3)),
        ("decimal", "+.5", {}, Decimal("0.5")),
        ("decimal", "5.", {}, Decimal(5)),
        ("decimal", "1.100000000000000", {}, Decimal("1.1")),
        ("boolean", "TRUE", {}, True),
        ("boolean", " 0 ", {}, False),
        ("text", "   ", {}, None),
        ("date", "", {}, None),
        ("decimal", None, {}, None),
    ],
)
def test_accepted(spark, kind, raw, kw, value):
    assert one(spark, raw, kind, **kw) == (value, [], "Done")


@pytest.mark.parametrize(
    "kind, raw, kw, reason",
    [
        ("text", " \t ", {"required": True}, "Required"),
        ("date", None, {"required": True}, "Required"),
        ("date", "2026-02-30", {}, "InvalidDate"),
        ("date", "31/01/2026", {}, "InvalidDate"),
        ("date", "2026-1-5", {}, "InvalidDate"),
        ("date", "0000-01-05", {}, "InvalidDate"),
        ("date", "2026-01-05T00:00:00", {}, "InvalidDate"),
        ("date", "31-01-2026", {"format": "dd/MM/yyyy"}, "InvalidDate"),
        ("decimal", "1,234.50", {}, "InvalidDecimal"),
        ("decimal", "12a", {}, "InvalidDecimal"),
        ("decimal", "1e3", {}, "InvalidDecimal"),
        ("decimal", "1 2", {}, "InvalidDecimal"),
        ("decimal", ".", {}, "InvalidDecimal"),
        ("decimal", "1" * 29, {}, "Overflow"),
        ("decimal", "0.12345678901", {}, "Overflow"),
        ("boolean", "yes", {}, "InvalidBoolean"),
        ("boolean", "t", {}, "InvalidBoolean"),
        ("text", "abcdef", {"max_length": 5}, "TooLong"),
    ],
)
def test_refused(spark, kind, raw, kw, reason):
    value, reasons, status = one(spark, raw, kind, **kw)
    assert (reasons, status) == ([reason], "Invalid")


def test_all_failing_fields_are_kept(spark):
    fields = [C.Field("a", "a_out", "date", True), C.Field("b", "b_out", "decimal", True), C.Field("c", "c_out")]
    df = spark.createDataFrame([(1, "x", "y", "z")], "id int, a string, b string, c string")
    row = normalize(df, fields, ("id",)).first()
    assert [(e.field, e.reason) for e in row.errors] == [("a_out", "InvalidDate"), ("b_out", "InvalidDecimal")]


def test_legacy_conversions(spark):
    df = spark.createDataFrame([("31/01/2026", "1,234.50", "1,234.00", "")], "d string, m string, n string, e string")
    row = df.select(
        C.legacy_date(F.col("d")), C.legacy_decimal(F.col("m")), C.legacy_int(F.col("n")), C.legacy_date(F.col("e")),
        C.legacy_timestamp(F.col("d")),
    ).first()
    assert tuple(row) == (dt.date(2026, 1, 31), Decimal("1234.50"), 1234, None, dt.datetime(2026, 1, 31))


@pytest.mark.parametrize(
    "name, problem",
    [("orders", None), ("order_no", None), ("Orders", "BadName"), ("1abc", "BadName"), ("a-b", "BadName"), ("a;drop", "BadName"),
     ("a" * 63, None), ("a" * 64, "BadName"), ("pg_x", "BadName"), ("row_number", "ReservedName")],
)
def test_identifiers(spark, name, problem):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(text.identifier_problem(F.col("n"))).first()[0] == problem


def test_config_cannot_carry_code():
    with pytest.raises(ValueError):
        rules.predicate(rules.Predicate("a", "1=1 OR", "x"))
    with pytest.raises(ValueError):
        rules.column_expr(rules.ColumnMap("t", "s"), (rules.Condition("t", 1, "SELECT 1"),))
    with pytest.raises(ValueError):
        rules.default_expr(rules.ColumnMap("t", type="DATETIME", default="GETDATE()"))
    with pytest.raises(ValueError):
        rules.typed_value(rules.ColumnMap("t", "s", "NDATE"))
    with pytest.raises(TypeError):
        rules.register_conversion("x", "upper(a)")


def test_date_formats(spark):
    assert C.usable_date_format("dd/MM/yyyy") and not C.usable_date_format("yyyy-QQ") and not C.usable_date_format("MM/yyyy")
    cases = {
        "d/M/yyyy": {"5/3/2024": "2024-03-05", "15/12/2024": "2024-12-15", "31/2/2024": None, "005/3/2024": None},
        "dd MMM yyyy": {"05 Mar 2024": "2024-03-05", "05 Foo 2024": None, "5 Mar 2024": None},
        "dd/MM/yy": {"05/03/24": "2024-03-05", "05/03/2024": None}, "yyyyMMdd": {"20240305": "2024-03-05", "2024-03-05": None},
    }
    for fmt, texts in cases.items():
        assert C.usable_date_format(fmt)
        df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", C.to_date(F.col("t"), fmt).cast("string").alias("d"))
        assert {r.t: r.d for r in df.collect()} == texts


def test_operation_key_parts_do_not_run_together(spark):
    df = spark.createDataFrame([("a|", "b"), ("a", "|b")], "x string, y string")
    found = {r[0] for r in df.select(keys.operation_key(F.col("x"), F.col("y"))).collect()}
    assert len(found) == 2


def test_archive_root_must_not_be_below_input():
    assert keys.archive_below_input("/in/archive", "/in") and not keys.archive_below_input("/inbox", "/in")
