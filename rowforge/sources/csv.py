"""CSV deliveries: header, quoting, newlines inside quotes, every field a string.

Files are read without a header so that each file's own column order counts. Lines are
stored once, by split; header check, numbering and projection all work on the records
read from them, in a first read as in a retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.operators.intake import with_row_number
from rowforge.operators.skew import attach
from rowforge.sources import stored
from rowforge.sources.files import Snapshot, stored_files
from rowforge.sources.lines import accept

QUOTED = r'(^|,)"(?:[^"]++|"")*+"'
RAW = "_raw"
PARSED = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n", "columnNameOfCorruptRecord": RAW}


def cell_schema(width: int) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in (*[f"c{i}" for i in range(width)], RAW)])


def cell_count(record: Column) -> Column:
    """Cells of a record's text: commas outside quoted cells, and one."""
    bare = F.regexp_replace(record, QUOTED, "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def header_width(texts: DataFrame) -> int:
    """Cells of the widest header among the files."""
    first = texts.filter((F.col("_block") == 0) & (F.col("_pos") == 1)).groupBy("file").agg(F.min_by("record", "_pos").alias("head"))
    return first.agg(F.max(cell_count(F.col("head")))).first()[0] or 1


def land(spark: SparkSession, paths: list[str] | str, width: int | None = None, charset: str = "UTF-8") -> DataFrame:
    """Records of the files as ``parse`` gives them, from lines stored by many tasks a file."""
    return parse(stored_files(spark, paths), width, charset)


def parse(snapshot: Snapshot, width: int | None = None, charset: str = "UTF-8") -> DataFrame:
    """(file, _block, _pos, cells, n_cells, raw) of every record, header included, from stored lines.

    Without ``width`` the widest header decides. A record of another length keeps its text in ``raw``
    and its length in ``n_cells``, so no cell is lost. Positions count the records of a split, so they
    are the same in every read of a snapshot."""
    texts = stored.texts(snapshot.lines, snapshot.splits, charset)
    width = width or header_width(texts)
    ddl = ", ".join(f"{n} string" for n in cell_schema(width).names)
    rows = texts.select("file", "_block", "_pos", F.from_csv("record", ddl, PARSED).alias("r"))
    return rows.select(
        "file", "_block", "_pos", F.array(*[F.col(f"r.c{i}") for i in range(width)]).alias("cells"),
        n_cells(F.col(f"r.{RAW}"), width), F.col(f"r.{RAW}").alias("raw"),
    )


def unclosed(snapshot: Snapshot) -> DataFrame:
    """Files in which a quote never closes, with the number of the record that opens it; a file-level failure."""
    before = parse(snapshot, 1).select("file", "_block", "_pos")
    counts = attach(before.withColumnRenamed("_block", "_b").withColumnRenamed("_pos", "_p"), stored.unclosed(snapshot.splits), ["file"], "right")
    at = counts.groupBy("file").agg(F.count("_p").alias("n"))
    return at.select(
        "file", F.lit("ImportFailed").alias("import_status"),
        F.concat(F.lit("Unclosed quote in record "), F.col("n").cast("string")).alias("last_error"),
    )


def n_cells(raw: Column, width: int) -> Column:
    return F.when(raw.isNull(), width).otherwise(cell_count(raw)).cast("int").alias("n_cells")


def ragged(landed: DataFrame, heads: DataFrame) -> DataFrame:
    """(file, row_number, n_cells, header_cells, reason, raw) of records whose length differs from their header's."""
    named = heads.select("file", "_header_pos", "header_cells")
    body = attach(landed, named, ["file"], "inner").filter((F.col("_block") > 0) | (F.col("_pos") > F.col("_header_pos")))
    numbered = with_row_number(body.select("file", "_block", "_pos", "n_cells", "header_cells", "raw"), "file")
    reason = F.when(F.col("n_cells") > F.col("header_cells"), "TooManyCells").otherwise("TooFewCells")
    return numbered.filter(F.col("n_cells") != F.col("header_cells")).select(
        "file", "row_number", "n_cells", "header_cells", reason.alias("reason"), "raw"
    )


def headers(landed: DataFrame) -> DataFrame:
    """Header cells per file: the first record of the first split."""
    return (
        landed.filter((F.col("_block") == 0) & (F.col("_pos") == 1))  # records of a split count from 1, so no other is parsed
        .groupBy("file")
        .agg(F.min_by(F.struct("cells", "n_cells"), "_pos").alias("_first"), F.min("_pos").alias("_header_pos"))
        .select("file", "_header_pos", "_first.cells", F.col("_first.n_cells").alias("header_cells"))
        .select(
            "file", "_header_pos", "header_cells",
            F.transform("cells", lambda c: F.btrim(F.replace(c, F.lit("\ufeff"), F.lit("")))).alias("header"),
        )
    )


def lacking(required: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.array_compact("header"))


def repeated(required: list[str]) -> Column:
    """Required headers that name more than one column."""
    return F.filter(F.array(*[F.lit(r) for r in required]), lambda r: F.size(F.filter("header", lambda h: h == r)) > 1)


def repeated_headers(heads: DataFrame, required: list[str]) -> DataFrame:
    """Files in which a required header occurs twice, with the names; which column is meant is not guessed."""
    return (
        heads.withColumn("twice", repeated(required))
        .filter(F.size("twice") > 0)
        .select(
            "file", F.lit("ImportFailed").alias("import_status"),
            F.concat(F.lit("Repeated header: "), F.array_join("twice", ", ")).alias("last_error"),
        )
    )


def missing_headers(heads: DataFrame, required: list[str]) -> DataFrame:
    """Files without a required header, with the names; a file-level failure, no row errors."""
    return (
        heads.withColumn("missing", lacking(required))
        .filter(F.size("missing") > 0)
        .select(
            "file", F.lit("ImportFailed").alias("import_status"),
            F.concat(F.lit("Missing header: "), F.array_join("missing", ", ")).alias("last_error"),
        )
    )


def records(landed: DataFrame, heads: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Numbered Source rows of the files whose header holds each name once, columns found by header name."""
    names = [h for h, _ in rules]
    good = heads.filter((F.size(lacking(names)) == 0) & (F.size(repeated(names)) == 0))
    body = (
        attach(landed, good, ["file"], "inner")
        .filter((F.col("_block") > 0) | (F.col("_pos") > F.col("_header_pos")))
    )
    named = body.select("file", "_block", "_pos", *[cell(h).alias(s) for h, s in rules])
    return with_row_number(named, "file")


def cell(header: str) -> Column:
    at = F.array_position("header", F.lit(header)).cast("int")
    return F.get("cells", at - 1)


def positional(landed: DataFrame) -> DataFrame:
    """Header names become ``ColumnN_header`` by their place; a blank one leaves its place without a name.

    Cells keep their position; rows without text in the first five cells are left out, as on sheets."""
    heads = headers(landed).select(
        "file", "_header_pos",
        F.transform("header", lambda h, i: F.when(h != "", F.concat(F.lit("Column"), (i + 1).cast("string"), F.lit("_"), h))).alias("names"),
    )
    return (
        attach(landed, heads, ["file"], "inner")
        .filter((F.col("_block") > 0) | (F.col("_pos") > F.col("_header_pos")))
        .filter(accept("sheet", F.col("cells")))
        .select("file", "_block", "_pos", "names", "cells")
    )
