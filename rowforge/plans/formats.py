"""Queries: older text formats and sheets, with part and supplier rendered as deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.operators import export as X
from rowforge.operators.ordered import id_range, number_rows
from rowforge.plans.catalog import Tables, query
from rowforge.session import fresh_path
from rowforge.sources import csv as S
from rowforge.sources import lines as P
from rowforge.sources.stored import raw_lines

BRAND_NO = "CAST(replace(p_brand, 'Brand#', '') AS INTEGER)"
LINES_SQL = f"""lines AS (SELECT p_brand AS file, p_partkey,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line_no,
  CASE WHEN {BRAND_NO} % 2 = 0 THEN rpad(p_name, 15, ' ') || lpad(CAST(p_size AS VARCHAR), 4, ' ') || p_type
       WHEN p_partkey % 40 = 0 THEN 'the application date|' || p_name
       WHEN p_partkey % 33 = 0 THEN p_name
       ELSE p_partkey || '|" ' || p_name || '"| ' || p_type || chr(9) || '|' || p_size END AS line FROM part)"""


def brand_no() -> Column:
    return F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int")


def lines(t: Tables) -> DataFrame:
    """Even brands are fixed-width files, odd ones pipe files with header and stray lines."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    fixed = F.concat(F.rpad("p_name", 15, " "), F.lpad(size, 4, " "), F.col("p_type"))
    piped = F.concat(key.cast("string"), F.lit('|" '), F.col("p_name"), F.lit('"| '), F.col("p_type"), F.lit("\t|"), size)
    line = (
        F.when(brand_no() % 2 == 0, fixed)
        .when(key % 40 == 0, F.concat(F.lit("the application date|"), F.col("p_name")))
        .when(key % 33 == 0, F.col("p_name")).otherwise(piped)
    )
    rows = t.part.select(F.col("p_brand").alias("file"), "p_partkey", line.alias("line"))
    return number_rows(rows, ["file"], ["p_partkey"], id_range(F.col("p_partkey")), out="line_no")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Small rows dealt to all cores, by ``keys`` where given, before they become large or files; a scan's splits may hold less than they tell."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def first_cells(df: DataFrame, n: int, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.get("cells", F.lit(i)).alias(f"value{i + 1}") for i in range(n)])


@query(
    "parse_pipe",
    f"""WITH {LINES_SQL} SELECT file, line_no, trim(string_split(line, '|')[1]) AS value1,
      trim(replace(string_split(line, '|')[2], '"', '')) AS value2,
      trim(string_split(line, '|')[3], chr(9) || ' ') AS value3, string_split(line, '|')[4] AS value4
    FROM lines WHERE contains(line, '|') AND NOT contains(line, 'application date|')""",
)
def parse_pipe(t: Tables) -> DataFrame:
    return first_cells(P.parse_pipe(lines(t)), 4, "file", "line_no")


@query(
    "parse_fixed",
    f"""WITH {LINES_SQL} SELECT file, line_no, trim(substring(line, 1, 15)) AS value1, trim(substring(line, 16, 4)) AS value2,
      trim(substring(line, 20, 30)) AS value3
    FROM lines WHERE line_no > 1 AND trim(substring(line, 1, 15)) <> ''
      AND file NOT IN (SELECT file FROM lines WHERE contains(line, '|') AND NOT contains(line, 'application date|'))""",
)
def parse_fixed(t: Tables) -> DataFrame:
    """Fixed width is tried only for files that gave no pipe row."""
    layout = [P.Slot(1, 15), P.Slot(16, 4), P.Slot(20, 30)]
    return first_cells(P.parse_fixed_width(lines(t), layout), 3, "file", "line_no")


@query(
    "simple_csv",
    """SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS value1, p_name AS value2, p_type AS value3
    FROM part WHERE p_size <> 7""",
)
def simple_csv(t: Tables) -> DataFrame:
    """Plain comma lines; lines naming LOTNO are headings."""
    line = F.when(F.col("p_size") == 7, F.lit("NO,LOTNO,NAME")).otherwise(
        F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), F.col("p_name"), F.lit('"')), "p_type")
    )
    return first_cells(P.parse_simple_csv(t.part.select("p_partkey", line.alias("line"))), 3, "p_partkey")


@query(
    "slice_records",
    """WITH n AS (SELECT p_brand AS file, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
    SELECT file, p_partkey, rn - 3 AS row_number FROM n WHERE rn > 3""",
)
def slice_records(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("file"), "p_partkey")
    numbered = number_rows(rows, ["file"], ["p_partkey"], id_range(F.col("p_partkey")))
    return P.slice_records(numbered, 2, 5)


SHEETS_SQL = """sheets AS (SELECT p_brand AS file, p_type || '$' AS raw_sheet, p_partkey,
  CASE p_type WHEN 'ECONOMY' THEN 2 WHEN 'PROMO' THEN 0 ELSE 1 END AS sheet_idx,
  CASE WHEN p_size > 10 THEN ' ' || p_name || ' ' ELSE ' ' END AS c1, CAST(NULL AS VARCHAR) AS c2, '' AS c3, chr(9) AS c4,
  CASE WHEN p_size > 5 THEN CAST(p_size AS VARCHAR) ELSE '' END AS c5, 'tail' AS c6 FROM part)"""


def sheets(t: Tables) -> DataFrame:
    size = F.col("p_size")
    cells = F.array(
        F.when(size > 10, F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).otherwise(" "), F.lit(None).cast("string"),
        F.lit(""), F.lit("\t"), F.when(size > 5, size.cast("string")).otherwise(""), F.lit("tail"),
    )
    idx = F.when(F.col("p_type") == "ECONOMY", 2).when(F.col("p_type") == "PROMO", 0).otherwise(1)
    return t.part.select(
        F.col("p_brand").alias("file"), F.concat(F.lit("'"), F.col("p_type"), F.lit("$'")).alias("sheet"), "p_partkey",
        idx.alias("sheet_idx"), cells.alias("cells"),
    )


@query(
    "sheet_rows",
    f"""WITH {SHEETS_SQL} SELECT file, replace(raw_sheet, '$', '') AS sheet, p_partkey, trim(c1) AS value1, c2 AS value2,
      c3 AS value3, '' AS value4, c5 AS value5, c6 AS value6 FROM sheets
    WHERE trim(c1) <> '' OR trim(c5) <> ''""",
)
def sheet_rows(t: Tables) -> DataFrame:
    """Rows with text in any of the first five cells, over all sheets."""
    return first_cells(P.accept_sheet_rows(sheets(t)), 6, "file", "sheet", "p_partkey")


@query(
    "first_sheet",
    f"""WITH {SHEETS_SQL} SELECT file, p_partkey, sheet_idx FROM sheets s
    WHERE sheet_idx = (SELECT min(sheet_idx) FROM sheets x WHERE x.file = s.file)""",
)
def first_sheet(t: Tables) -> DataFrame:
    return P.first_sheet(sheets(t)).select("file", "p_partkey", "sheet_idx")


@query(
    "merge_files",
    f"""WITH {SHEETS_SQL} SELECT 'MergeFiles_20260131' AS output, p_partkey, trim(c1) AS "VALUE1", c2 AS "VALUE2", c3 AS "VALUE3",
      '' AS "VALUE4", c5 AS "VALUE5" FROM sheets WHERE raw_sheet = 'PROMO$' AND (trim(c1) <> '' OR trim(c5) <> '')""",
)
def merge_files(t: Tables) -> DataFrame:
    """One sheet of every file merged, from two deliveries; the heading rule leaves out totals and caps the columns."""
    kept = P.accept_sheet_rows(sheets(t))
    named = kept.select(
        "file", "sheet", "p_partkey", *[F.get("cells", F.lit(i)).alias(f"VALUE{i + 1}") for i in range(5)],
        F.get("cells", F.lit(5)).alias("VALUE_TOTAL"),
    )
    even = F.col("file").substr(-1, 1).cast("int") % 2 == 0
    merged = X.merge_files([named.filter(even).drop("file"), named.filter(~even).drop("file")], "PROMO")
    return X.merge_output(merged, 23, keep=("p_partkey",)).withColumn(
        "output", X.merge_name(F.lit("2026-01-31").cast("date"))
    )


@query(
    "value_columns",
    """SELECT p_partkey, CAST(p_size AS VARCHAR) AS "VALUE1", p_name AS "VALUE2" FROM part""",
)
def value_columns(t: Tables) -> DataFrame:
    wide = t.part.select(
        "p_partkey", F.col("p_size").cast("string").alias("VALUE1"), F.col("p_name").alias("VALUE2"),
        F.col("p_retailprice").alias("VALUE_TOTAL"), F.col("p_type").alias("VALUE3"),
    )
    return X.merge_output(wide, 2, keep=("p_partkey",))


@query(
    "positional_columns",
    f"""WITH {LINES_SQL}, p AS (SELECT *, string_split(line, '|') AS c FROM lines
      WHERE contains(line, '|') AND NOT contains(line, 'application date|'))
    SELECT file, CAST(line_no AS VARCHAR) AS "RowNumber", trim(c[1]) AS "PartNo", trim(replace(c[2], '"', '')) AS "PartName",
      CAST(NULL AS VARCHAR) AS "Spare", file AS source_file, '20260131' AS create_date, 'I' AS stat_flag FROM p""",
)
def positional_columns(t: Tables) -> DataFrame:
    """Cells into named staging columns by field number, 0 being the row ordinal."""
    from rowforge.operators.normalize import with_staging_columns

    layout = [("PartName", 2), ("RowNumber", 0), ("Spare", 9), ("PartNo", 1)]
    cells = P.parse_pipe(lines(t)).drop("p_partkey").withColumnRenamed("line_no", "row_number")
    columns = P.positional_to_columns(cells, layout)
    staged = with_staging_columns(
        columns.withColumn("source_file", F.col("file")), F.col("file"), F.lit("2026-01-31").cast("date"), F.lit(None).cast("string")
    )
    return staged.drop("trans_id", "row_number")


@query(
    "positional_gaps",
    """SELECT s_suppkey, 'Column1_Key' AS name1, CAST(NULL AS VARCHAR) AS name2, 'Column3_Nation' AS name3, s_name AS value2,
      CAST(s_nationkey AS VARCHAR) AS value3 FROM supplier WHERE s_suppkey % 7 <> 0""",
)
def positional_gaps(t: Tables) -> DataFrame:
    """A blank header keeps its place; rows with text only after the fifth cell are not accepted."""
    path = fresh_path(t.spark, "positional-gaps")
    empty = F.col("s_suppkey") % 7 == 0
    cell = lambda c: F.when(~empty, F.col(c).cast("string"))
    t.supplier.select(
        cell("s_suppkey").alias("Key"), cell("s_name").alias(" "), cell("s_nationkey").alias("Nation"),
        *[F.lit(None).cast("string").alias(f"x{k}") for k in range(2)], F.lit("tail").alias("Tail"),
    ).write.option("header", True).csv(path)
    rows = S.positional(S.land(t.spark, path))
    value, name = (lambda i: F.get("cells", F.lit(i))), (lambda i: F.get("names", F.lit(i)))
    return rows.select(
        value(0).cast("bigint").alias("s_suppkey"), name(0).alias("name1"), name(1).alias("name2"), name(2).alias("name3"),
        value(1).alias("value2"), value(2).alias("value3"),
    )


@query(
    "slice_overruns",
    """SELECT p_brand AS file, 'ImportFailed' AS import_status, 'Slice of 90 rows leaves nothing of ' || count(*) AS last_error
    FROM part GROUP BY p_brand HAVING count(*) <= 90""",
)
def slice_overruns(t: Tables) -> DataFrame:
    """Files no longer than the cut fail as files."""
    rows = t.part.select(F.col("p_brand").alias("file"), "p_partkey")
    return P.slice_overruns(number_rows(rows, ["file"], ["p_partkey"], id_range(F.col("p_partkey"))), 10, 100)


@query(
    "parse_fixed_long",
    """SELECT p_brand AS file, p_partkey, p_name AS value1, p_type AS value2, '' AS value3 FROM part""",
)
def parse_fixed_long(t: Tables) -> DataFrame:
    """A slot that begins after 6000 characters, and one past the end of the line."""
    padded = F.substring(F.concat("p_name", F.lit(" " * 6500)), 1, 6500)  # rpad puts its spaces in one by one
    line = F.concat(padded, F.col("p_type"))
    parts = dealt(t.part.select("p_brand", "p_partkey", "p_name", "p_type"))
    rows = parts.select(F.col("p_brand").alias("file"), "p_partkey", F.lit(2).alias("line_no"), line.alias("line"))
    layout = [P.Slot(1, 30), P.Slot(6501, 40), P.Slot(9000, 10)]
    return first_cells(P.parse_fixed_width(rows, layout), 3, "file", "p_partkey")


@query(
    "positional_csv",
    """SELECT s_suppkey, 'Column1_Supp Key' AS name1, 'Column2_Name' AS name2, s_name AS value2,
      CAST(s_nationkey AS VARCHAR) AS value3 FROM supplier""",
)
def positional_csv(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "positional")
    t.supplier.select(
        F.col("s_suppkey").alias("Supp Key"), F.col("s_name").alias("Name"), F.col("s_nationkey").alias("Nation")
    ).write.option("header", True).csv(path)
    rows = S.positional(S.land(t.spark, path, 3))
    value = lambda i: F.get("cells", F.lit(i))
    return rows.select(
        value(0).cast("bigint").alias("s_suppkey"), F.get("names", F.lit(0)).alias("name1"),
        F.get("names", F.lit(1)).alias("name2"), value(1).alias("value2"), value(2).alias("value3"),
    )


@query(
    "charset_lines",
    """SELECT s_suppkey, unnest([1, 2]) AS line_no, unnest(['ชื่อลูกค้า ' || s_name, 'บรรทัด|' || s_nationkey]) AS line FROM supplier""",
)
def charset_lines(t: Tables) -> DataFrame:
    """One file per supplier, in the character set of its partner, read in splits and decoded line by line."""
    text = F.concat(F.lit("ชื่อลูกค้า "), F.col("s_name"), F.lit("\r\nบรรทัด|"), F.col("s_nationkey").cast("string"))
    partner = F.when(F.col("s_nationkey") % 3 == 0, "TIB").otherwise("KK")
    # the text writer puts out the bytes of a string as they are
    coded = F.when(partner == "TIB", F.encode(text, "UTF-8")).otherwise(F.encode(text, P.DEFAULT_CHARSET)).cast("string")
    path = fresh_path(t.spark, "charsets")
    # tasks write files of their own suppliers and put them in place themselves, not the driver one after the other
    files = dealt(t.supplier.select("s_suppkey", partner.alias("partner"), coded.alias("value")), "partner", "s_suppkey")
    files.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("partner", "s_suppkey").text(path)
    lines = P.read_lines(raw_lines(t.spark, path), partner=F.regexp_extract("file", "partner=([^/]+)", 1))
    return lines.select(F.regexp_extract("file", "s_suppkey=([0-9]+)", 1).cast("bigint").alias("s_suppkey"), "line_no", "line")
