"""Older text formats: pipe, fixed width, plain comma, and sheet rows.

All take DataFrames of lines or cells, so any reader can feed them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.functions.text import non_blank, padded_slice, trimmed
from rowforge.operators.intake import with_row_number
from rowforge.operators.skew import attach
from rowforge.session import stage
from rowforge.sources.stored import decoded

# Character set per partner; every other partner uses the default.
CHARSETS = {"TIB": "UTF-8"}
DEFAULT_CHARSET = "x-windows-874"


@dataclass(frozen=True)
class Slot:
    """One fixed-width field: start from 1 and a length."""

    start: int
    length: int


def read_lines(raw: DataFrame, partner: Column) -> DataFrame:
    """(file, line_no, line) from ``stored.raw_lines``, decoded by partner.

    The partner decides between branches, as a character set must be a literal. Lines are stored once,
    so that each keeps its split and place; a file is read by as many tasks as it has splits."""
    lines = stage(raw.select("file", "_block", "_pos", "line"), "raw")
    text = decoded(F.col("line"), DEFAULT_CHARSET)
    for name, charset in CHARSETS.items():
        text = F.when(partner == name, decoded(F.col("line"), charset)).otherwise(text)
    numbered = with_row_number(lines.select("file", "_block", "_pos", F.regexp_replace(text, "\r\\z", "").alias("line")), "file")
    return numbered.select("file", F.col("row_number").cast("int").alias("line_no"), "line")


def clean_cells(cells: Column) -> Column:
    return F.transform(cells, lambda c: trimmed(F.replace(c, F.lit('"'), F.lit(""))))


def is_header_line(line: Column) -> Column:
    return line.contains("application date|")


def parse_pipe(lines: DataFrame) -> DataFrame:
    """Lines with more than one cell; header lines are skipped."""
    cells = F.split("line", r"\|")
    return (
        lines.filter(~is_header_line(F.col("line")) & F.col("line").contains("|"))
        .withColumn("cells", clean_cells(cells))
        .drop("line")
    )


def fixed_cells(line: Column, layout: list[Slot]) -> Column:
    """Every slot of the layout; a line that ends before a slot gives it as empty."""
    return F.array(*[trimmed(padded_slice(line, s.start, s.length)) for s in layout])


def parse_fixed_width(lines: DataFrame, layout: list[Slot]) -> DataFrame:
    """Only for files without a single pipe row; line 1 is skipped, Value1 must not be blank.

    Cells are cut out before the files are compared, so no line is shuffled."""
    piped = lines.filter(~is_header_line(F.col("line")) & F.col("line").contains("|")).select("file").distinct()
    rows = (
        lines.filter(F.col("line_no") > 1)
        .withColumn("cells", fixed_cells(F.col("line"), layout))
        .filter(non_blank(F.get("cells", F.lit(0))))
        .drop("line")
    )
    return attach(rows, piped, ["file"], "left_anti")


def parse_simple_csv(lines: DataFrame) -> DataFrame:
    return (
        lines.filter(~F.col("line").contains("LOTNO"))
        .withColumn("cells", F.transform(F.split("line", ","), lambda c: F.replace(c, F.lit('"'), F.lit(""))))
        .drop("line")
    )


# ---- sheets -------------------------------------------------------------


def accept(kind: str, cells: Column) -> Column:
    """Row acceptance of each format."""
    if kind == "sheet":
        return F.exists(F.slice(cells, 1, 5), non_blank)
    if kind == "pipe":
        return F.size(cells) > 1
    if kind == "fixed":
        return non_blank(F.get(cells, F.lit(0)))
    raise ValueError(f"unknown format {kind!r}")


def accept_sheet_rows(cells: DataFrame) -> DataFrame:
    """All sheets as one list; sheet names lose ``$`` and quotes."""
    return (
        cells.filter(accept("sheet", F.col("cells")))
        .withColumn("sheet", F.translate("sheet", "$'", ""))
        .withColumn("cells", F.transform("cells", trimmed))
    )


def first_sheet(cells: DataFrame) -> DataFrame:
    """Rows of each file's first sheet."""
    firsts = cells.groupBy("file").agg(F.min("sheet_idx").alias("sheet_idx"))
    return attach(cells, firsts, ["file", "sheet_idx"], "left_semi")


def slice_records(df: DataFrame, start: int, finish: int, number: str = "row_number") -> DataFrame:
    """Drop the first ``finish - start`` rows of each list when both are set, and renumber.

    Numbers are contiguous, so renumbering is a subtraction. A cut past the end leaves nothing."""
    cut = finish - start if start > 0 and finish > start else 0
    return df.filter(F.col(number) > cut).withColumn(number, F.col(number) - cut)


def slice_overruns(df: DataFrame, start: int, finish: int, file: str = "file", number: str = "row_number") -> DataFrame:
    """Files that a cut leaves without any row: failed as files."""
    cut = finish - start if start > 0 and finish > start else 0
    sizes = df.groupBy(file).agg(F.max(number).alias("n_rows"))
    return sizes.filter((F.col("n_rows") <= cut) & (F.lit(cut) > 0)).select(
        file, F.lit("ImportFailed").alias("import_status"),
        F.concat(F.lit(f"Slice of {cut} rows leaves nothing of "), F.col("n_rows").cast("string")).alias("last_error"),
    )


def positional_to_columns(df: DataFrame, layout: list[tuple[str, int]], ordinal: Column | None = None) -> DataFrame:
    """(column, field) pairs by field: 0 is the row ordinal, others the cell of that number."""
    keep = [c for c in df.columns if c != "cells"]
    row = ordinal if ordinal is not None else F.col("row_number")
    picked = [
        (row.cast("string") if field == 0 else F.get("cells", F.lit(field - 1))).alias(name)
        for name, field in sorted(layout, key=lambda x: x[1])
    ]
    return df.select(*[c for c in keep if c not in {n for n, _ in layout}], *picked)


def value_columns(names: list[str], n: int = 23) -> list[str]:
    """First ``n`` VALUE columns, totals left out."""
    return [c for c in names if "VALUE" in c.upper() and "TOTAL" not in c.upper()][:n]
