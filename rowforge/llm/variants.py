"""Spelling variants: words one inserted, deleted or replaced code point apart, each grouped under its most frequent neighbour.

Words are numbered along two tries. Node numbers come from sorted words: a word shares the nodes of its
longest common prefix with the word before it and opens one new node per code point after that. Words are
sorted in ranges, each numbered by its own task; one small row per range tells which of its first nodes an
earlier range has opened. Reversed words give the suffix nodes. A word of L code points is L + 1 *split* pairs
(prefix node, suffix node) that meet at a position, and L *skip* pairs that leave out the code point there:

* two skip pairs are equal: the words differ by the code point left out;
* a skip pair equals a split pair: the second word is the first without that code point. Of a run of equal
  code points only the first is skipped here, so each such neighbour is met once.

The join is an aggregate by pair. A pair is skipped by at most one word per letter and split by one word, so
no group exceeds the alphabet, whatever the input. Counts and the best neighbour leave the group, never pairs.

A null text has no words and a null doc_id counts as empty; repeated rows count again; an empty table gives an
empty result; other columns are ignored. Ties go to the smallest word in code-point order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, takewhile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.llm.store import drop, stage

# Letters of a run, and how runs are changed and chosen.
RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHANGED = 199
LENGTH, OFTEN, RATIO = 6, 5, 5

SHIFT = 40  # a node is its range above and its place in the range below
ROOT = -1
SKIP, SKIP_FIRST, SPLIT = 0, 1, 2
PAIR = "p long, s long, id long, n long, kind int"


def runs(docs: DataFrame, length: int = LENGTH, changed: int = CHANGED) -> DataFrame:
    """(word) per run of letters that may give a word of ``length`` code points, with the agreed deletions."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), CAPITALS, SMALL)
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    long = each.where(F.char_length("run") >= length).select("run", h.alias("h"), F.char_length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    word = F.when(F.col("h") % changed == 0, cut).otherwise(F.col("run"))
    return long.select(word.alias("word")).where(F.char_length("word") >= length)


def vocabulary(docs: DataFrame, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """(word, n) of the words with at least ``often`` occurrences."""
    return runs(docs, length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return sum(1 for _ in takewhile(lambda k: a[k] == b[k], count()))


def opened(words: DataFrame, by: Column, path: str) -> DataFrame:
    """``words`` with ``path``, the nodes of the prefixes of ``by`` as its range numbers them, ``_range`` and ``_place``. Written once."""
    sorted_ = words.withColumn("_by", by).repartitionByRange("_by").sortWithinPartitions("_by")
    schema = T.StructType([*sorted_.schema, T.StructField("_range", T.IntegerType()), T.StructField("_place", T.LongType()), T.StructField(path, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        base, place, last, nodes = own << SHIFT, 0, "", np.zeros(0, np.int64)
        free = 0
        for batch in batches:
            paths, sizes = [], []
            for word in batch.column("_by").to_pylist():
                shared = common(last, word)
                fresh = len(word) - shared
                nodes = np.concatenate([nodes[:shared], np.arange(base + free, base + free + fresh)])
                free, last = free + fresh, word
                paths.append(nodes)
                sizes.append(len(nodes))
            n = len(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(paths) if n else nodes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, own, np.int32)), pa.array(np.arange(place, place + n)), lists], names=schema.fieldNames())
            place += n

    return stage(sorted_.mapInArrow(run, schema), "trie")


class Aliases:
    """Which first nodes of a range are nodes that an earlier range has opened: at most one word's nodes per range."""

    def __init__(self, numbered: DataFrame, path: str):
        ends = numbered.groupBy("_range").agg(F.min("_by").alias("first"), F.max(F.struct("_by", path)).alias("last")).collect()  # a row per range
        known, last, nodes = {}, "", np.zeros(0, np.int64)
        for own, first, (word, path_) in sorted(ends):
            known[own] = nodes[: common(last, first)]
            last, nodes = word, self._settle(np.array(path_, np.int64), own, known[own])
        self.start = np.zeros(max(known, default=0) + 2, np.int64)
        self.start[1:] = np.cumsum([len(known.get(k, ())) for k in range(len(self.start) - 1)])
        self.nodes = np.concatenate([*known.values(), np.zeros(0, np.int64)])

    @staticmethod
    def _settle(nodes: np.ndarray, own: int, known: np.ndarray) -> np.ndarray:
        at = nodes & ((1 << SHIFT) - 1)
        out = nodes.copy()
        hit = (nodes >> SHIFT == own) & (at < len(known))
        out[hit] = known[at[hit]]
        return out

    def settle(self, nodes: np.ndarray) -> np.ndarray:
        """``nodes`` with every alias replaced by the node it stands for."""
        own, at = nodes >> SHIFT, nodes & ((1 << SHIFT) - 1)
        hit = at < self.start[own + 1] - self.start[own]
        out = nodes.copy()
        out[hit] = self.nodes[self.start[own[hit]] + at[hit]]
        return out


def settled(numbered: DataFrame, path: str) -> DataFrame:
    """``numbered`` with the nodes of ``path`` alike in all ranges."""
    shared = numbered.sparkSession.sparkContext.broadcast(Aliases(numbered, path))
    schema = numbered.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(path)
            lists = batch.column(k)
            nodes = shared.value.settle(np.asarray(lists.flatten()))
            sizes = np.asarray(lists.value_lengths())
            new = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(nodes))
            yield pa.RecordBatch.from_arrays([new if i == k else c for i, c in enumerate(batch.columns)], names=schema.fieldNames())

    return numbered.mapInArrow(run, schema)


def pairs(words: DataFrame) -> DataFrame:
    """PAIR rows of words (id, word, n, forward, backward)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                size = np.asarray(part.column("forward").value_lengths()).astype(np.int64)
                start = np.concatenate([[0], np.cumsum(size)])
                ends = start[1:] + np.arange(1, len(size) + 1)  # ends of L + 1 places per word
                word = np.repeat(np.arange(len(size)), size + 1)
                place = np.arange(ends[-1] if len(ends) else 0) - np.concatenate([[0], ends[:-1]])[word]
                left = size[word] - place
                f, b = np.asarray(part.column("forward").flatten()), np.asarray(part.column("backward").flatten())
                p = np.where(place > 0, f[np.maximum(start[word] + place - 1, 0)], ROOT)
                s = np.where(left > 0, b[np.maximum(start[word] + left - 1, 0)], ROOT)
                points = np.frombuffer("".join(part.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
                skip = np.flatnonzero(left > 0)
                at = start[word[skip]] + place[skip]
                fresh = (place[skip] == 0) | (points[at] != points[np.maximum(at - 1, 0)])
                who = np.concatenate([word[skip], word])
                ids, n = np.asarray(part.column("id"))[who], np.asarray(part.column("n"))[who]
                kind = np.concatenate([np.where(fresh, SKIP_FIRST, SKIP), np.full(len(word), SPLIT)]).astype(np.int32)
                columns = [np.concatenate([p[skip], p]), np.concatenate([s[skip + 1], s]), ids, n, kind]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["p", "s", "id", "n", "kind"])

    return words.select("id", "word", "n", "forward", "backward").mapInArrow(run, PAIR)


def neighbours(met: DataFrame) -> DataFrame:
    """(id, n_near, best) from PAIR rows: how many words are near, and the most frequent one as (n, -id)."""
    member = F.struct("n", (-F.col("id")).alias("minus"), "kind")
    groups = met.groupBy("p", "s").agg(F.sort_array(F.collect_list(member), asc=False).alias("all")).where(F.size("all") > 1)  # at most an alphabet
    name = lambda x: F.when(x.isNotNull(), F.struct(x["n"].alias("n"), x["minus"].alias("minus")))
    of = lambda test: F.filter("all", test)
    skips, firsts, whole = of(lambda x: x["kind"] != SPLIT), of(lambda x: x["kind"] == SKIP_FIRST), of(lambda x: x["kind"] == SPLIT)
    told = groups.select(
        F.size(skips).alias("n_skips"), F.size(firsts).alias("n_firsts"), name(F.get(skips, F.lit(0))).alias("top"), name(F.get(skips, F.lit(1))).alias("second"),
        name(F.get(firsts, F.lit(0))).alias("top_first"), name(F.get(whole, F.lit(0))).alias("whole"), F.explode("all").alias("x"),
    )
    kind, whole = F.col("x.kind"), F.when(F.col("x.kind") == SKIP_FIRST, F.col("whole"))
    rival = F.when(F.col("x.minus") == F.col("top.minus"), F.col("second")).otherwise(F.col("top"))
    near = F.when(kind == SPLIT, F.col("n_firsts")).otherwise(F.col("n_skips") - 1 + whole.isNotNull().cast("int"))
    best = F.when(kind == SPLIT, F.col("top_first")).otherwise(F.greatest(rival, whole))
    each = told.select((-F.col("x.minus")).alias("id"), near.alias("near"), best.alias("best")).where("near > 0")
    return each.groupBy("id").agg(F.sum("near").cast("long").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, up): the last id upwards. Each round doubles the steps and is written before the next."""
    now, moved = stage(forms.select("id", "up", F.lit(True).alias("moved")), "forms"), True
    while moved:
        further = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        step = now.join(further, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))
        after = stage(step, "forms")
        drop(now)
        now, moved = after, after.where("moved").limit(1).count() > 0
    return now.select("id", F.col("up").alias("root"))


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n), by the pairs of their trie nodes."""
    words = stage(words.select("word", "n"), "words")
    ahead = opened(words, F.col("word"), "forward")
    drop(words)
    named = settled(ahead, "forward").select((F.shiftleft(F.col("_range").cast("long"), SHIFT) + F.col("_place")).alias("id"), "word", "n", "forward")
    back = opened(named, F.reverse("word"), "backward")
    known = back.select("id", "word", "n")
    near = stage(neighbours(pairs(settled(back, "backward"))), "near")
    drop(ahead)
    judged = known.join(near, "id", "left")
    has = F.col("best.n") >= ratio * F.col("n")
    judged = stage(
        judged.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, -F.col("best.minus")).alias("up"), F.when(has, F.col("best.n")).alias("form_n")),
        "judged",
    )
    last = roots(judged.where("up IS NOT NULL"))
    text = judged.select("id", "word")
    linked = (
        judged.where("up IS NOT NULL").join(last, "id")
        .join(text.toDF("up", "form"), "up").join(text.toDF("root", "root_word"), "root")
        .select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")
    )
    alone = judged.where("up IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return alone.unionByName(linked)


def variants(docs: DataFrame) -> DataFrame:
    """One row per word of ``docs``: its form, root, count and number of near words."""
    return group(vocabulary(docs))
