"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Pieces have whole lengths from 1 to ``room``, so pieces and gaps, range-sorted, are at most ``room`` runs of
equal length each, however large the input is. A round takes the longest pieces left (one run). The sweep
finds their successor, the run of smallest gaps that hold them; pieces of a run that want the same gaps are
told apart by rank, the i-th going to the i-th gap; the gaps shrink, and the round repeats with what is left
until it opens new sequences. Only runs (length, count) are swept; the rows themselves are ranked within
their run and given their sequence by distributed joins."""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowforge.llm.store import stage

ROOM = 2048
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
# The vocabulary's pattern with possessive repeats: the same matches with less backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SPECIAL = "<|endoftext|>"
END = np.zeros(1, np.uint32)
SALTS = 256
BLOCK = 1 << 20
SMALL_PLAN = 100_000
REMEMBERED = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of the public byte-level vocabulary, equal to what ``tokenizers`` gives for its JSON file.

    The same ranks through tiktoken take a quarter of the time; texts that name the special token or that
    its regular expression can't match go to ``tokenizers``."""

    def __init__(self, path: str | None = None, ranks: str | None = None):
        self.path = path or public_tokenizers.path(VOCABULARY)
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.exact: Tokenizer | None = None

    def slow(self, text: str) -> np.ndarray:
        if self.exact is None:
            self.exact = Tokenizer.from_file(self.path)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return self.slow(text)
        try:
            return np.array(self.quick.encode_ordinary(text), np.uint32)
        except BaseException as e:  # the library's panics are no Exceptions
            if type(e).__name__ not in ("PanicException", "ValueError"):
                raise
            return self.slow(text)


def cut(ids: np.ndarray, room: int) -> list[tuple[int, int, int, int]]:
    """piece, start, length, crc32 of a document's ids, the end id included; a longer document's first piece may be short."""
    ids = np.concatenate([ids, END])
    first = len(ids) % room or room
    bounds = [0, *range(first, len(ids) + 1, room)] if len(ids) > room else [0, len(ids)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


def tokenize(docs: DataFrame, room: int = ROOM, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces of each document. Null texts hold only the end id; repeated rows give repeated pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = Encoder(path, ranks), {}
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                key = blake2b(text.encode(), digest_size=16).digest()
                found = known.get(key)
                if found is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    found = known[key] = cut(encode(text), room)
                rows += [(doc_id, *piece) for piece in found]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], room: int = ROOM) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Plan of runs (length, first rank, count, first sequence, offset) and the number of sequences.

    Pieces of ``length`` with ranks first rank .. + count go to as many consecutive sequences, at ``offset``."""
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gaps that have runs, ascending
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps.setdefault(gap, []):
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(at)
            else:
                gap, first, n = room, opened, -(-left // (room // length))
                opened += n
            each = gap // length
            full, rest = min(n, left // each), 0
            if full < n:
                rest = left - full * each
                leave(gap, first + full + (rest > 0), n - full - (rest > 0))
            for slot in range(each if full else 0):
                plan.append((length, rank, full, first, room - gap + slot * length))
                rank += full
            for slot in range(rest):
                plan.append((length, rank, 1, first + full, room - gap + slot * length))
                rank += 1
            leave(gap - each * length, first, full)
            if rest:
                leave(gap - rest * length, first + full, 1)
            left = counts[length] - rank
    return plan, opened


def ranked(pieces: DataFrame) -> DataFrame:
    """``rank`` from 0 within each length. Ranks are dealt per salt, so that no length is one task's work."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        salted.withColumn("_row", F.row_number().over(within)).join(offsets, ["length", "_salt"])
        .withColumn("rank", F.col("_before") + F.col("_row") - 1).drop("_salt", "_row", "_before")
    )


def pack(docs: DataFrame, room: int = ROOM, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    spark = docs.sparkSession
    pieces = stage(tokenize(docs, room, path, ranks), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``room`` rows
    plan, _ = best_fit(counts, room)
    runs = [(n, block, first, count, seq, offset) for n, first, count, seq, offset in plan for block in range(first // BLOCK, (first + count - 1) // BLOCK + 1)]
    table = spark.createDataFrame(runs, "_length long, _block long, _first long, _count long, _sequence long, offset long")
    if len(runs) <= SMALL_PLAN:
        table = F.broadcast(table)
    rows = ranked(pieces).withColumn("_at", F.floor(F.col("rank") / BLOCK))
    near = (F.col("length") == F.col("_length")) & (F.col("_at") == F.col("_block"))
    mine = (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_first") + F.col("_count"))
    return rows.join(table, near & mine).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("rank") - F.col("_first")).alias("sequence_id"), "offset"
    )
