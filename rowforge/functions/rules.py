"""Configured column rules and row predicates, compiled to Column expressions.

Only names in the tables below are accepted, so configuration can never carry
SQL or script text into a plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowforge.functions import convert as C
from rowforge.functions.text import non_blank, trimmed


@dataclass(frozen=True)
class Condition:
    """A special rule for one target column; the lowest sequence wins."""

    target: str
    sequence: int
    kind: str
    args: tuple = ()


@dataclass(frozen=True)
class ColumnMap:
    target: str
    source: str | None = None
    type: str = "STRING"
    default: str | None = None


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: object = None


@dataclass(frozen=True)
class TargetMap:
    """All columns of one target table, with its conditions and row filter."""

    target_id: str
    sequence: int
    columns: tuple[ColumnMap, ...]
    conditions: tuple[Condition, ...] = ()
    where: tuple[Predicate, ...] = field(default=())


# ---- predicates ---------------------------------------------------------

PREDICATES: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "contains": lambda c, v: c.contains(v),
    "blank": lambda c, v: ~non_blank(c),
    "not_blank": lambda c, v: non_blank(c),
}


def predicate(p: Predicate) -> Column:
    if p.op not in PREDICATES:
        raise ValueError(f"unsupported predicate {p.op!r}")
    return PREDICATES[p.op](F.col(p.column), p.value)


def all_of(predicates) -> Column:
    return reduce(lambda a, b: a & b, [predicate(p) for p in predicates], F.lit(True))


# ---- column rules -------------------------------------------------------


def when_rule(p: Predicate, then: Column, otherwise: Column) -> Column:
    return F.when(predicate(p), then).otherwise(otherwise)


def concat_rule(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def substr_rule(c: Column, start: int, length: int) -> Column:
    return F.substring(c, start, length)


def replace_rule(c: Column, search: str, replacement: str) -> Column:
    return F.replace(c, F.lit(search), F.lit(replacement))


def split_rule(c: Column, delimiter: str, part: int) -> Column:
    return F.split_part(c, F.lit(delimiter), F.lit(part))


def stuff_rule(c: Column, start: int, length: int, text: str) -> Column:
    """Delete ``length`` characters at ``start`` and put ``text`` there."""
    return F.overlay(c, F.lit(text), F.lit(start), F.lit(length))


RULES: dict[str, Callable[..., Column]] = {
    "iif": lambda col, op, value, then, other: when_rule(Predicate(col, op, value), F.lit(then), F.lit(other)),
    "concat": lambda *cols: concat_rule(*[F.col(c) for c in cols]),
    "substring": lambda col, start, length: substr_rule(F.col(col), start, length),
    "replace": lambda col, a, b: replace_rule(F.col(col), a, b),
    "split": lambda col, delimiter, part: split_rule(F.col(col), delimiter, part),
    "stuff": lambda col, start, length, text: stuff_rule(F.col(col), start, length, text),
    "convert": lambda col, name: conversion(name)(F.col(col)),
}

DEFAULT_EXPRESSIONS: dict[str, Callable[[], Column]] = {"now": F.current_timestamp, "today": F.current_date}

TYPED: dict[str, Callable[[Column], Column]] = {
    "STRING": trimmed,
    "DATE": C.legacy_date,
    "DATETIME": C.legacy_timestamp,
    "DECIMAL": C.legacy_decimal,
    "INT": C.legacy_int,
    "UNIQUEIDENTIFIER": C.to_uuid,
}
CASTS = {"STRING": "string", "DATE": "date", "DECIMAL": "decimal(12,2)", "INT": "int", "UNIQUEIDENTIFIER": "string"}


def default_expr(m: ColumnMap) -> Column:
    """A literal of the target type; a DATETIME default names an allowed expression."""
    if m.type == "DATETIME":
        if m.default not in DEFAULT_EXPRESSIONS:
            raise ValueError(f"unsupported default {m.default!r} for {m.target}")
        return DEFAULT_EXPRESSIONS[m.default]()
    return F.lit(m.default).cast(CASTS[m.type])


def typed_sources(columns: tuple[ColumnMap, ...]) -> list[str]:
    """Source columns whose trimmed copy the typed rules read."""
    return [m.source for m in columns if m.source is not None and m.type != "STRING"]


def typed_value(m: ColumnMap) -> Column:
    if m.type not in TYPED:
        raise ValueError(f"unsupported type {m.type!r} for {m.target}")
    return TYPED[m.type](F.col(m.source if m.type == "STRING" else f"_t_{m.source}"))


def column_expr(m: ColumnMap, conditions: tuple[Condition, ...] = (), value: Column | None = None) -> Column:
    """First matching condition, else the default, else the typed source column.

    ``value`` is the typed value when an earlier projection already made it."""
    mine = sorted((c for c in conditions if c.target == m.target), key=lambda c: c.sequence)
    if mine:
        if mine[0].kind not in RULES:
            raise ValueError(f"unsupported rule {mine[0].kind!r}")
        return RULES[mine[0].kind](*mine[0].args).alias(m.target)
    if m.source is None:
        return default_expr(m).alias(m.target)
    value = typed_value(m) if value is None else value
    if m.default is not None:
        value = F.coalesce(value, default_expr(m))
    return value.alias(m.target)


def conversion_failed(m: ColumnMap, value: Column | None = None) -> Column:
    """True when a typed column has text but no value."""
    if m.source is None or m.type == "STRING":
        return F.lit(False)
    return (F.coalesce(F.col(f"_t_{m.source}"), F.lit("")) != "") & (typed_value(m) if value is None else value).isNull()


# ---- partner conversions ------------------------------------------------

_CONVERSIONS: dict[str, Callable[[Column], Column]] = {}


def register_conversion(name: str, fn: Callable[[Column], Column]) -> None:
    """Make a Column→Column function available to configuration under ``name``."""
    if not callable(fn):
        raise TypeError("a conversion is a function from Column to Column; SQL text is refused")
    _CONVERSIONS[name] = fn


def conversion(name: str) -> Callable[[Column], Column]:
    if name not in _CONVERSIONS:
        raise ValueError(f"unknown conversion {name!r}")
    return _CONVERSIONS[name]


register_conversion("digits_only", lambda c: F.regexp_replace(c, "[^0-9]", ""))
register_conversion("upper_trim", lambda c: F.upper(trimmed(c)))
