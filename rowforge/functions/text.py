"""Text functions shared by every reader and converter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode code points counted as white space when trimming.
WHITE_SPACE_RANGES = (
    (0x0009, 0x000D), (0x0020, 0x0020), (0x0085, 0x0085), (0x00A0, 0x00A0),
    (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F),
    (0x205F, 0x205F), (0x3000, 0x3000),
)
WHITE_SPACE = "".join(chr(c) for low, high in WHITE_SPACE_RANGES for c in range(low, high + 1))

# Column names owned by the system, never allowed for data.
RESERVED_NAMES = (
    "id", "file_job_id", "row_number", "imported_at", "source_row_id",
    "row_job_id", "config_version_id", "normalized_at",
)
IDENTIFIER = "^[a-z][a-z0-9_]{0,62}$"

# Database error numbers the partner can correct.
PARTNER_ERROR_NUMBERS = (2628, 8152, 241, 245, 8114, 8115, 515, 547, 2627, 2601)


def trimmed(c: Column) -> Column:
    """Strip all Unicode white space from both ends (plain trim strips spaces only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def with_trimmed(df: DataFrame, names: list[str]) -> DataFrame:
    """Trimmed copies under ``_t_name``, so that later expressions name a column, not the trimming."""
    return df.withColumns({f"_t_{n}": trimmed(F.col(n)) for n in dict.fromkeys(names)})


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def non_blank(c: Column) -> Column:
    return F.coalesce(trimmed(c) != "", F.lit(False))


def strip_quotes(c: Column, quotes: str = "'\"") -> Column:
    return F.translate(c, quotes, "")


def system_id_parts(c: Column) -> tuple[Column, Column]:
    """``mode-type`` → (mode, type); without a dash the type stays empty."""
    return F.split_part(c, F.lit("-"), F.lit(1)), F.split_part(c, F.lit("-"), F.lit(2))


def padded_slice(line: Column, start: int, length: int) -> Column:
    return F.substring(line, start, length)


def identifier_problem(c: Column) -> Column:
    """Reason a table or column name is refused, or null."""
    return (
        F.when(c.isNull() | ~c.rlike(IDENTIFIER), F.lit("BadName"))
        .when(c.startswith("pg_"), F.lit("BadName"))
        .when(c.isin(*RESERVED_NAMES), F.lit("ReservedName"))
    )


def error_category(number: Column) -> Column:
    """Partner can fix data errors; anything else, null included, is for operations."""
    return F.when(number.isin(*PARTNER_ERROR_NUMBERS), "partner").otherwise("system")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LONG_NUMBER = r"[0-9]{6,}"
SECRET = r"(?i)(password|secret|token|api_key)(\s*[:=]\s*)[^\s]+"


def masked(c: Column) -> Column:
    """Hide mail addresses, secrets and long digit runs before a text leaves the system."""
    out = F.regexp_replace(c, SECRET, "$1$2***")
    out = F.regexp_replace(out, EMAIL, "***@***")
    return F.regexp_replace(out, LONG_NUMBER, "######")
