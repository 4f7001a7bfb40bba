"""Arrays of optional items, and a point predicates are not pushed through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(items: list[tuple[Column, Column]]) -> Column:
    """Array of the items whose condition holds. Unlike array_compact, whose lambda is
    interpreted row by row, this stays inside generated code."""
    return F.concat(*[F.array_repeat(item, F.coalesce(when, F.lit(False)).cast("int")) for when, item in items])


def settled(df: DataFrame, keep: list[str] | tuple[str, ...], columns: list[Column]) -> DataFrame:
    """``keep`` plus the computed columns, evaluated once.

    A filter above a plain projection is pushed below it with every expression it needs
    copied in, so costly conversions would run twice. A one-row generator stops that."""
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))
