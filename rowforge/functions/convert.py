"""Field conversions. Each returns (value, reason); exactly one of them is set,
or neither when an optional field is blank. All are native expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowforge.functions.arrays import present

# Reasons written to row errors.
REQUIRED, BAD_DATE, BAD_DECIMAL, BAD_BOOLEAN = "Required", "InvalidDate", "InvalidDecimal", "InvalidBoolean"
OVERFLOW, TOO_LONG, BAD_INT, BAD_UUID = "Overflow", "TooLong", "InvalidInteger", "InvalidUuid"

DEFAULT_DATE_FORMAT = "yyyy-MM-dd"
PLAIN_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
PLAIN_INTEGER = r"^[+-]?[0-9]+$"
UUID_PATTERN = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DATE_FORMAT_SHAPE = r"^(y{4}|y{2}|M{1,4}|d{1,2}|H{1,2}|h{1,2}|m{1,2}|s{1,2}|a|[-/. :,])+$"


@dataclass(frozen=True)
class Field:
    """One source-to-normalized rule joined with its target column definition."""

    source: str
    target: str
    kind: str = "text"  # text, date, decimal, boolean
    required: bool = False
    format: str | None = None
    precision: int = 38
    scale: int = 10
    max_length: int | None = None


def usable_date_format(fmt: str) -> bool:
    return bool(re.match(DATE_FORMAT_SHAPE, fmt)) and all(p in fmt for p in "yMd")


def exact_shape(fmt: str) -> str:
    """Regex for text of exactly the shape of a date format; there is no year 0. A single letter takes one or two
    digits; three or four M are a month's name."""

    def part(m: re.Match) -> str:
        letters = m.group()
        if letters[0] == "a":
            return "[AaPp][Mm]"
        if letters[0] == "M" and len(letters) > 2:
            return "[A-Za-z]{3}" if len(letters) == 3 else "[A-Za-z]{3,9}"
        return "[0-9]{1,2}" if len(letters) == 1 else f"[0-9]{{{len(letters)}}}"

    shape = re.sub(r"([A-Za-z])\1*", part, fmt.replace(".", "\\."))
    return "^" + shape.replace("[0-9]{4}", "(?!0000)[0-9]{4}") + "$"


# Converters take a trimmed column of an earlier projection. They name it more than once,
# which is cheap for a column and costs every repeat of the work for an expression.


def to_date(c: Column, fmt: str | None = None) -> Column:
    """Exact parse. Formats of one yyyy, MM and dd are cut at their fixed places and cast,
    which costs a third of a formatter call."""
    fmt = fmt or DEFAULT_DATE_FORMAT
    if sorted(re.findall("[A-Za-z]+", fmt)) != ["MM", "dd", "yyyy"]:
        return F.when(c.rlike(exact_shape(fmt)), F.try_to_date(c, fmt))
    parts = [F.substring(c, fmt.index(p) + 1, len(p)) for p in ("yyyy", "MM", "dd")]
    iso = c if fmt == DEFAULT_DATE_FORMAT else F.concat_ws("-", *parts)
    return F.when(c.rlike(exact_shape(fmt)), iso.try_cast("date"))


def to_timestamp(c: Column, fmt: str) -> Column:
    return F.when(c.rlike(exact_shape(fmt)), F.try_to_timestamp(c, F.lit(fmt)))


def to_decimal(c: Column, precision: int = 38, scale: int = 10) -> Column:
    """Sign, digits and point only. More digits than the type holds give null, never a rounded value."""
    fraction = f"[0-9]{{0,{scale}}}0*"
    pattern = rf"^[+-]?([0-9]+(\.{fraction})?|\.(?=[0-9]){fraction})$"
    return F.when(c.rlike(pattern), c.try_cast(f"decimal({precision},{scale})"))


def to_boolean(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def legacy_date(c: Column) -> Column:
    return to_date(c, "dd/MM/yyyy")


def legacy_timestamp(c: Column) -> Column:
    return to_timestamp(c, "dd/MM/yyyy")


def legacy_decimal(c: Column, precision: int = 12, scale: int = 2) -> Column:
    plain = F.replace(c, F.lit(","), F.lit(""))
    return F.when(plain.rlike(PLAIN_DECIMAL), plain.try_cast(f"decimal({precision},{scale})"))


def legacy_int(c: Column) -> Column:
    plain = F.replace(F.replace(c, F.lit(","), F.lit("")), F.lit(".00"), F.lit(""))
    return F.when(plain.rlike(PLAIN_INTEGER), plain.try_cast("int"))


def to_uuid(c: Column) -> Column:
    return F.when(c.rlike(UUID_PATTERN), F.lower(c))


def converted(c: Column, f: Field) -> Column:
    """Typed value of an already trimmed column (null when blank or not convertible)."""
    if f.kind == "text":
        return F.nullif(c, F.lit(""))
    if f.kind == "date":
        return to_date(c, f.format)
    if f.kind == "decimal":
        return to_decimal(c, f.precision, f.scale)
    if f.kind == "boolean":
        return to_boolean(c)
    raise ValueError(f"unsupported type {f.kind!r} for {f.target}")


def reason(raw: Column, value: Column, f: Field) -> Column:
    """Why a field fails, or null. ``raw`` is trimmed."""
    blank = F.coalesce(raw, F.lit("")) == ""
    out = F.when(F.lit(f.required) & blank, REQUIRED)
    failed = ~blank & value.isNull()
    if f.kind == "date":
        out = out.when(failed, BAD_DATE)
    elif f.kind == "decimal":
        out = out.when(failed & raw.rlike(PLAIN_DECIMAL), OVERFLOW).when(failed, BAD_DECIMAL)
    elif f.kind == "boolean":
        out = out.when(failed, BAD_BOOLEAN)
    if f.max_length is not None:
        out = out.when(F.length(raw) > f.max_length, TOO_LONG)
    return out


NO_ERRORS = "array<struct<field:string,reason:string>>"


def all_errors(pairs: list[tuple[str, Column]]) -> Column:
    """array<struct<field,reason>> of every failing field, in field order."""
    items = [(r.isNotNull(), F.struct(F.lit(n).alias("field"), r.alias("reason"))) for n, r in pairs]
    good = F.coalesce(*[r for _, r in pairs]).isNull()
    return F.when(good, F.array().cast(NO_ERRORS)).otherwise(present(items).cast(NO_ERRORS))
