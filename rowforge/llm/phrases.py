"""Phrases whose words keep company, by marginal counts of the longest windows alone.

Texts are split into pieces and words. Every word opens one window: itself and the words that follow it in its
piece, up to ``order`` columns, padded with null. Only these longest windows are counted; ROLLUP sums them over
ever shorter prefixes, which gives the counts of all shorter phrases and, at the top, the words of a language.

A window also ends where a pair of words is too rare for any phrase. Pairs are counted by hash first and the
frequent ones marked in a bitmap of bounded size (``ids.MOST_BITS``), which may only err towards longer
windows: a phrase that occurs ``least`` times consists of pairs that do, so its windows, and those of its parts,
are never cut and its counts are exact however full the bitmap is.

A null text is empty and a null lang is ``und``; repeated rows count again; an empty table gives an empty
result; other columns are ignored. Languages of any number and size share all tasks: counts are combined before
each shuffle, and the ranking keeps each task's first ``top`` rows of a language."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm import text as T
from rowforge.llm.ids import MOST_BITS, PAGE
from rowforge.llm.store import drop, stage

# What ends a piece, what separates words, and the thresholds of the report.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
ORDER, LEAST, TOP, SHARE, SCALE = 4, 30, 2000, 80, 2_000_000
UNKNOWN = "und"

PIECE_END = np.zeros(256, bool)
PIECE_END[list(ENDS)] = True
LETTERS = np.ones(256, np.uint8)
LETTERS[list(ENDS + BLANKS)] = 0
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
MOST = 1 << 20  # bytes of text handled at a time


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Rows and texts of near ``MOST`` bytes; a longer text is cut behind ends of pieces, so no phrase is."""
    for a, b in T.pieces(texts, MOST):
        part = texts.slice(a, b - a)
        data, _ = T.utf8(part)
        if b - a > 1 or len(data) <= MOST:
            yield np.arange(a, b), part
            continue
        ends = np.flatnonzero(PIECE_END[data]) + 1
        at = np.searchsorted(ends, np.arange(MOST, len(data), MOST))
        cuts = np.unique(np.concatenate([[0], ends[at[at < len(ends)]], [len(data)]]))
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.array([a]), pa.array([data[start:stop].tobytes().decode()], pa.large_string())


def follows(found: T.Words) -> np.ndarray:
    """Whether the word after each word lies in the same piece."""
    piece = np.cumsum(PIECE_END[found.data])[found.start]
    out = np.zeros(len(found.row), bool)
    out[:-1] = (found.row[1:] == found.row[:-1]) & (piece[1:] == piece[:-1])
    return out


def pair_hashes(found: T.Words, lang: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the language and the two words from each word in ``at`` on."""
    return T.mix(T.chained([found.hash[at], found.hash[at + 1]]) + lang[found.row[at]])


def lang_codes(langs: pa.Array) -> np.ndarray:
    plain = langs.dictionary_encode()
    codes = np.array([zlib.crc32(x.encode()) for x in plain.dictionary.to_pylist()] or [0], np.uint64)
    return T.mix(codes)[np.asarray(plain.indices)]


def pair_counts(texts: DataFrame) -> DataFrame:
    """(h, n) of neighbouring words of texts (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = lang_codes(batch.column(0))
            for rows, part in chunks(batch.column(1)):
                found = T.words(part, T.FOLDED, LETTERS)
                h, n = np.unique(pair_hashes(found, codes[rows], np.flatnonzero(follows(found))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def marked(hashes: DataFrame) -> np.ndarray:
    """Bitmap of hashes (h), at most ``MOST_BITS`` bits whatever their number."""
    bits = int(min(MOST_BITS, max(PAGE, 1 << (16 * hashes.count()).bit_length())))
    place = hashes.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("p"))
    pages = place.groupBy(F.floor(F.col("p") / PAGE).alias("page")).agg(F.bitmap_construct_agg((F.col("p") % PAGE).cast("long")).alias("bits"))
    bitmap = np.zeros(bits // 8, np.uint8)
    for page, data in pages.collect():  # at most MOST_BITS / PAGE rows
        bitmap[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(data, np.uint8)
    return bitmap


def windows(texts: DataFrame, bitmap: np.ndarray, order: int = ORDER) -> DataFrame:
    """(lang, w1 .. w<order>, n): the longest window from every word on, counted."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)
    names = [f"w{k + 1}" for k in range(order)]
    schema = "lang string, " + ", ".join(f"{w} string" for w in names) + ", n long"

    def told(h: np.ndarray) -> np.ndarray:
        p = (h & np.uint64(len(shared.value) * 8 - 1)).astype(np.int64)
        return (shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, langs = lang_codes(batch.column(0)), batch.column(0)
            for rows, part in chunks(batch.column(1)):
                found = T.words(part, T.FOLDED, LETTERS)
                n = len(found.row)
                if not n:
                    continue
                linked = follows(found)
                at = np.flatnonzero(linked)
                linked[at] = told(pair_hashes(found, codes[rows], at))
                text = pa.LargeStringArray.from_buffers(
                    n, pa.py_buffer(np.concatenate([[0], np.cumsum(found.end - found.start)])), pa.py_buffer(FOLD[found.data[LETTERS[found.data] > 0]])
                )
                text, lang = text.dictionary_encode(), langs.take(pa.array(rows)).dictionary_encode()
                single = np.flatnonzero(~linked)
                many = max(1, len(lang.dictionary))
                both, counts = np.unique(np.asarray(text.indices)[single].astype(np.int64) * many + np.asarray(lang.indices)[found.row[single]], return_counts=True)
                empty = pa.nulls(len(both), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(both % many)).cast(pa.string()), text.dictionary.take(pa.array(both // many)).cast(pa.string()), *[empty] * (order - 1), pa.array(counts.astype(np.int64))],
                    names=["lang", *names, "n"],
                )
                first, words = np.flatnonzero(linked), text.indices
                columns = [words.take(pa.array(first))]
                alive = np.ones(len(first), bool)
                for k in range(1, order):
                    alive &= linked[np.minimum(first + k - 1, n - 1)]
                    columns.append(words.take(pa.array(np.minimum(first + k, n - 1), mask=~alive)))
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(np.asarray(lang.indices)[found.row[first]])).cast(pa.string()),
                        *[text.dictionary.take(c).cast(pa.string()) for c in columns], pa.array(np.ones(len(first), np.int64)),
                    ],
                    names=["lang", *names, "n"],
                )

    return texts.mapInArrow(run, schema).groupBy("lang", *names).agg(F.sum("n").alias("n"))


def marginals(counted: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, f) of phrases with at least ``least`` occurrences; size 0 counts all words of the language."""
    names = [f"w{k + 1}" for k in range(order)]
    level = F.grouping_id()
    sums = counted.rollup("lang", *names).agg(F.sum("n").alias("f"), level.alias("level"))
    # a prefix of k words leaves out order - k columns; padding is no word, so such a prefix is none either
    size = F.lit(None).cast("int")
    for k, w in enumerate(["lang", *names]):
        size = F.when((F.col("level") == (1 << (order - k)) - 1) & F.col(w).isNotNull(), k).otherwise(size)
    return sums.select("lang", size.alias("size"), F.concat_ws(" ", *names).alias("phrase"), "f").where((F.col("size") == 0) | (F.col("size") > 0) & (F.col("f") >= least))


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(grams: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two or more words, by their lowest-scoring cut."""
    many = grams.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = many.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part("w", F.lit(1), F.col("k")).alias("left"), _part("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    parts = grams.where("size >= 1").select("lang", "phrase", "f")
    both = cut.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    both = both.withColumns({"x": wide("a") * F.lit(SCALE), "y": wide("l") + wide("r")})
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("x div y").alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def covered(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, phrase, longer): the largest count among the longer phrases that hold a phrase."""
    many = grams.where("size >= 3").select("lang", "f", "size", F.split("phrase", " ").alias("w"))
    found = None
    for length in range(2, order):
        starts = F.sequence(F.lit(1), F.col("size") - length + 1)
        inside = many.where(F.col("size") > length).select("lang", "f", "w", F.explode(starts).alias("at")).select("lang", _part("w", F.col("at"), F.lit(length)).alias("phrase"), "f")
        found = inside if found is None else found.unionByName(inside)
    return found.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def counts(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, f) of ``docs`` as ``marginals`` gives them, written once."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    often = stage(pair_counts(texts).where(F.col("n") >= least).select("h"), "pairs")
    bitmap = marked(often)
    drop(often)
    return stage(marginals(windows(texts, bitmap, order), order, least), "phrases")


def collocations(docs: DataFrame, order: int = ORDER, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    A phrase goes where a longer one that holds it keeps ``share`` percent of its occurrences."""
    grams = counts(docs, order, least)
    told = scored(grams)
    if order > 2:
        told = told.join(covered(grams, order), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = told.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= top)
    totals = grams.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
