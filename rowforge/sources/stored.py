"""Files kept as their lines: read in splits, whatever stands inside quotes.

A file is read by as many tasks as it has splits. Lines end at a line feed, which no byte of another character
can be in the character sets accepted here, so no character is cut at the edge of a split and lines are decoded
on their own. Whether a line begins inside a quoted cell depends on all lines before it: each task follows its
split under both assumptions, one small row per split carries the outcome over the file, and only the lines of
splits that turn out to begin inside quotes look at their second answer.

The stored lines are the snapshot of a file: the first read, every retry and the hash of the bytes come from
them, so their record numbers are equal. A record whose lines lie in one line needs no shuffle; only lines of
longer records are grouped. A quote that never closes would swallow the rest of its file: such a file fails as
a file, and the records before the quote are kept.

Null or empty files have no lines; blank lines outside quotes are no records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowforge.operators.skew import attach
from rowforge.session import stage

# A quote opens a cell only where the cell begins; whatever follows the closing quote belongs to the cell.
CLOSED = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+'
OPEN = rf'^(?:{CLOSED},)*+"(?:[^"]++|"")*+$'
SAME, TO_OUTSIDE, TO_INSIDE, SWAP = 0, 1, 2, 3
# Sets in which a line feed, a quote and a comma are one byte of their own.
PLAIN_CHARSETS = {"utf-8", "us-ascii", "iso-8859-1", "iso-8859-11", "iso-8859-15", "windows-1252", "windows-874", "x-windows-874", "cp874", "tis-620"}
BOM = b"\xef\xbb\xbf"
FLOW = "in0 boolean, in1 boolean, out0 boolean, out1 boolean, n0 long, n1 long"


def _turn(line: Column) -> Column:
    """What a line does to the state: keep it, or end outside, inside, or on the other side."""
    begun = lambda text: F.regexp_like(text, F.lit(OPEN))
    outside, inside = begun(line), begun(F.concat(F.lit('"'), line))
    turn = F.when(outside & inside, TO_INSIDE).when(~outside & ~inside, TO_OUTSIDE).when(outside, SWAP).otherwise(SAME)
    return F.when(F.contains(line, F.lit('"')), turn).otherwise(SAME)


def _follow(turn: np.ndarray, first: np.ndarray, state: bool) -> np.ndarray:
    """Whether each line begins inside quotes; ``state`` holds before line 0 and before the first line of any split that ``first`` marks."""
    n = len(turn)
    # two moments a line: before it a split may begin, after it the line may settle the state
    settles, value = np.zeros(2 * n, bool), np.zeros(2 * n, bool)
    settles[0::2], value[0::2] = first, state
    settles[1::2], value[1::2] = (turn == TO_OUTSIDE) | (turn == TO_INSIDE), turn == TO_INSIDE
    settles[0] = True
    last = np.maximum.accumulate(np.where(settles, np.arange(2 * n), -1))[0::2]
    swaps = np.concatenate([[0], np.cumsum(turn == SWAP)])
    return value[last] ^ ((swaps[np.arange(n)] - swaps[(last + 1) // 2]) % 2 == 1)


def _counted(begins: np.ndarray, first: np.ndarray, before: int) -> np.ndarray:
    """Records begun in the split up to and with each line; ``before`` were begun before line 0."""
    total = before + np.cumsum(begins)
    starts = np.flatnonzero(first)
    base = np.zeros(len(begins), np.int64)
    if len(starts):
        offset = total[starts] - begins[starts]
        base = np.where(np.arange(len(begins)) >= starts[0], offset[np.searchsorted(starts, np.arange(len(begins)), "right") - 1], 0)
    return total - base


def flow(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """State before and after each line and records begun so far, if its split begins outside (0) or inside (1) quotes.

    Rows come as the scan reads them: all lines of a split together and in order."""
    split: tuple[int, int] | None = None
    state, counts = [False, True], [0, 0]
    for file, block, turn, blank in batches:
        if not len(turn):
            yield pd.DataFrame({"in0": [], "in1": [], "out0": [], "out1": [], "n0": [], "n1": []})
            continue
        f, b, t, empty = file.to_numpy(np.int64), block.to_numpy(np.int64), turn.to_numpy(np.int64), blank.to_numpy(bool)
        first = np.ones(len(t), bool)
        first[1:] = (f[1:] != f[:-1]) | (b[1:] != b[:-1])
        first[0] = split != (f[0], b[0])
        out = {}
        for h in (0, 1):
            now = _follow(t, first, bool(h)) if first[0] else _follow_from(t, first, bool(h), state[h])
            after = np.where(t == SAME, now, np.where(t == SWAP, ~now, t == TO_INSIDE))
            n = _counted(~now & ~empty, first, 0 if first[0] else counts[h])
            out |= {f"in{h}": now, f"out{h}": after, f"n{h}": n}
            state[h], counts[h] = bool(after[-1]), int(n[-1])
        split = (f[-1], b[-1])
        yield pd.DataFrame(out)[["in0", "in1", "out0", "out1", "n0", "n1"]]


def _follow_from(turn: np.ndarray, first: np.ndarray, state: bool, carried: bool) -> np.ndarray:
    """As ``_follow``, with ``carried`` before line 0, which goes on with the split of the batch before."""
    if state == carried:
        return _follow(turn, first, state)
    cut = np.flatnonzero(first)
    to = cut[0] if len(cut) else len(turn)
    head = _follow(turn[:to], first[:to], carried)
    return np.concatenate([head, _follow(turn[to:], first[to:], state)]) if to < len(turn) else head


def raw_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, size, mtime, _block, _pos, line): every line's bytes with its split and place, in the order of the scan."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"), F.col("value").cast("binary").alias("line"),
    )


def store_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines of the files with their quote state as FLOW, written once."""
    lines = raw_lines(spark, paths).withColumn("_blank", F.col("line").isin(F.lit(b""), F.lit(b"\r")))
    flowed = lines.withColumn("_flow", F.pandas_udf(flow, FLOW)(F.xxhash64("file"), F.col("_block"), _turn(F.col("line").cast("string")).cast("long"), F.col("_blank")))
    return stage(flowed.select("file", "size", "mtime", "_block", "_pos", "line", "_blank", "_flow.*"), "lines")


def splits(lines: DataFrame) -> DataFrame:
    """One row per split: whether it begins inside quotes (``_inside``), the record open then (``_open``), and whether its end is open (``_ends_inside``)."""
    last = lines.groupBy("file", "_block").agg(F.max_by(F.struct("out0", "out1", "n0", "n1"), "_pos").alias("z"))
    settled, swap = F.col("z.out0") == F.col("z.out1"), F.col("z.out0") & ~F.col("z.out1")
    w = Window.partitionBy("file").orderBy("_block")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    known = last.withColumn("swaps", F.sum(swap.cast("int")).over(upto)).withColumn("fact", F.when(settled, F.struct(F.col("z.out0").alias("state"), F.col("swaps").alias("at"))))
    known = known.withColumn("last", F.last("fact", ignorenulls=True).over(before)).withColumn("done", F.coalesce(F.lag("swaps").over(w), F.lit(0)))
    odd = (F.col("done") - F.coalesce(F.col("last.at"), F.lit(0))) % 2 == 1
    entered = known.withColumn("_inside", F.coalesce(F.col("last.state"), F.lit(False)) != odd)
    ends = F.when(F.col("_inside"), F.col("z.out1")).otherwise(F.col("z.out0"))
    begun = F.when(F.col("_inside"), F.col("z.n1")).otherwise(F.col("z.n0"))
    opened = entered.withColumn("_ends_inside", ends).withColumn("own", F.when(F.col("_ends_inside") & (begun > 0), F.struct(F.col("_block").alias("block"), begun.alias("n"))))
    return stage(
        opened.withColumn("_open", F.when(F.col("_inside"), F.last("own", ignorenulls=True).over(before)))
        .withColumn("_rest", F.when(F.col("_ends_inside"), F.coalesce("own", "_open")))
        .select("file", "_block", "_inside", "_open", "_ends_inside", "_rest", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("_block"))).alias("_from_end")),
        "splits",
    )


def unclosed(found: DataFrame) -> DataFrame:
    """(file, _block, _pos) of the record in which a quote never closes, from ``splits``."""
    return found.where((F.col("_from_end") == 1) & F.col("_ends_inside")).select("file", F.col("_rest.block").alias("_block"), F.col("_rest.n").alias("_pos"))


def decoded(line: Column, charset: str = "UTF-8") -> Column:
    """A line's text; bytes that are no character become U+FFFD in UTF-8."""
    if charset.lower() not in PLAIN_CHARSETS:
        raise ValueError(f"lines can't be told apart by bytes in {charset!r}")
    return F.make_valid_utf8(line.cast("string")) if charset.lower() == "utf-8" else F.decode(line, charset)


def texts(lines: DataFrame, found: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """(file, _block, _pos, record) of every record but unclosed ones. ``_pos`` counts the records that begin in a split from 1."""
    inside = found.where("_inside").select("file", "_block", "_open")
    told = lines.join(inside.withColumnRenamed("_open", "_o"), ["file", "_block"], "left")
    of = lambda name: F.when(F.col("_o").isNotNull(), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    told = told.select("file", "_block", "_pos", "line", "_blank", of("in").alias("_in"), of("out").alias("_out"), of("n").alias("_n"), "_o")
    text = decoded(F.col("line"), charset)
    tidy = lambda c: F.regexp_replace(c, "\r\\z", "")
    single = told.where(~F.col("_in") & ~F.col("_out") & ~F.col("_blank")).select("file", "_block", F.col("_n").alias("_pos"), tidy(text).alias("record"))
    own = F.when(F.col("_n") > 0, F.struct(F.col("_block").alias("block"), F.col("_n").alias("n"))).otherwise(F.col("_o"))
    parts = told.where(F.col("_in") | F.col("_out")).select("file", own.alias("_r"), F.struct("_block", "_pos", text.alias("text")).alias("part"))
    lost = unclosed(found).select("file", F.struct(F.col("_block").alias("block"), F.col("_pos").alias("n")).alias("_r"))
    whole = attach(parts, lost, ["file", "_r"], "left_anti").groupBy("file", "_r").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    long = whole.select("file", F.col("_r.block").alias("_block"), F.col("_r.n").alias("_pos"), tidy(F.array_join(F.col("parts.text"), "\n")).alias("record"))
    return single.unionByName(long)


def hashes(lines: DataFrame) -> DataFrame:
    """(file, sha256) of each file's bytes, streamed line by line through one task per file."""
    # _rest: -1 or 2 without a line feed at the end, 2 or 3 with a byte order mark, which readers skip; its row comes first
    rest = (F.max("size") - F.sum(F.octet_length("line") + 1)).alias("_rest")
    heads = lines.groupBy("file").agg(rest).select("file", F.lit(-1).cast("long").alias("_block"), F.lit(-1).cast("long").alias("_pos"), F.lit(None).cast("binary").alias("line"), "_rest")
    rows = lines.select("file", "_block", "_pos", "line", F.lit(None).cast("long").alias("_rest")).unionByName(heads)
    rows = rows.repartition("file").sortWithinPartitions("file", "_block", "_pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, rest, fresh = None, None, 0, True

        def told() -> pa.RecordBatch:
            digest.update(b"\n" if rest in (0, 3) else b"")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], names=["file", "sha256"])

        for batch in batches:
            for file, line, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if left is not None:
                    if name is not None:
                        yield told()
                    name, rest, fresh = file, left, True
                    digest = hashlib.sha256(BOM if left in (2, 3) else b"")
                else:
                    digest.update(line if fresh else b"\n" + line)
                    fresh = False
        if name is not None:
            yield told()

    return rows.select("file", "line", "_rest").mapInArrow(run, "file string, sha256 string")
