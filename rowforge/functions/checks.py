"""Declared data-quality checks. Each is (field, reason, number, violated?)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.arrays import present
from rowforge.functions.text import error_category, non_blank, with_trimmed


@dataclass(frozen=True)
class Check:
    field: str
    reason: str
    number: int
    violated: Column
    trim: bool = False


def required(name: str) -> Check:
    return Check(name, "Required", 515, ~non_blank(F.col(name)))


def max_len(name: str, n: int) -> Check:
    return Check(name, "TooLong", 2628, F.length(F.col(name)) > n)


def convertible(name: str, converter: Callable[[Column], Column]) -> Check:
    text = F.col(f"_t_{name}")
    return Check(name, "NotConvertible", 241, (F.coalesce(text, F.lit("")) != "") & converter(text).isNull(), trim=True)


def fits(name: str, precision: int, scale: int) -> Check:
    """A well-formed number with more whole digits than decimal(precision, scale) holds, judged without commas as it is converted."""
    plain = F.replace(F.col(f"_t_{name}"), F.lit(","), F.lit(""))
    return Check(name, "Overflow", 8115, plain.rlike(rf"^[+-]?0*[1-9][0-9]{{{precision - scale},}}(\.[0-9]*)?$"), trim=True)


def check(name: str, holds: Column, reason: str = "CheckFailed") -> Check:
    return Check(name, reason, 547, ~F.coalesce(holds, F.lit(True)))


def flagged(name: str, reason: str, number: int, flag: str) -> Check:
    """A check whose answer a join or count already put into a boolean column."""
    return Check(name, reason, number, F.coalesce(F.col(flag), F.lit(False)))


def violations(df: DataFrame, keys: list[str], checks: list[Check]) -> DataFrame:
    """One row per violated check and input row.

    Checks become boolean columns first; exploding a ready-made array column instead
    would make the optimizer filter on its size and evaluate every check twice."""
    flags = [k.violated.alias(f"_bad_{i}") for i, k in enumerate(checks)]
    items = [
        (
            F.col(f"_bad_{i}"),
            F.struct(
                F.lit(k.field).alias("field"), F.lit(k.reason).alias("reason"), F.lit(k.number).alias("number"),
                error_category(F.lit(k.number)).alias("category"),
            ),
        )
        for i, k in enumerate(checks)
    ]
    texts = with_trimmed(df, [k.field for k in checks if k.trim])
    return texts.select(*keys, *flags).select(*keys, F.inline(present(items)))
