"""Benchmark items found in documents within a share of edits, by CGK embedding and bit-sampling LSH.

Texts are sequences of lower-case words (letters and digits). An item of m words is found where some run
of document words is at edit distance k = floor(m / 5) or less. Windows of item size start at every word;
counts of shared word pairs and triples, which no such run can fail (an edit breaks two or three), leave the
few worth embedding. The CGK walk turns edit
distance into Hamming distance: at step t it puts out the word it stands on and moves on if a random bit of
(t, word) says so. Each table samples a few steps of a walk; windows and items with equal samples meet and
the edit distance is then computed exactly.

The items are a query set, taken in blocks of bounded size; every block goes over all documents, which are
never shuffled. Items under ``LEAST`` words name no document and are left out."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm import text as T

EDITS = 0.2
LEAST = 5
WALKS = 8
TABLES = 8  # samplings per walk
SAMPLES = 2
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8 << 20
SEED = 11
HITS = "doc_id long, item_id long, edits int, item_words int"
BITS = 21


def budget(m: int, share: float = EDITS) -> int:
    return int(share * m + 1e-9)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word of letters and digits."""
    found = T.words(column, T.FOLDED, T.SYMBOLS)
    keep = T.SYMBOLS[found.data[found.start]] == 1
    return found.row[keep], found.hash[keep]


def distance(item: list[int], words: list[int]) -> int:
    """Smallest edit distance of ``item`` to a run of ``words``, bit-parallel over the item."""
    m = len(item)
    where: dict[int, int] = {}
    for k, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << k
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best = m
    for w in words:
        equal = where.get(w, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = (minus | ~(horizontal | plus)) & mask, plus & horizontal
        score += bool(up & top) - bool(down & top)
        best = min(best, score)
        up, down = up << 1 & mask, down << 1 & mask
        plus, minus = (down | ~(vertical | up)) & mask, up & vertical
    return best


class Index:
    """LSH tables over one block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDITS, walks: int = WALKS, tables: int = TABLES, samples: int = SAMPLES):
        row, code = letters(pa.array([t for _, t in items], pa.large_string()))
        first = np.searchsorted(row, np.arange(len(items) + 1))
        self.share, self.walks, self.tables, self.samples = share, walks, tables, samples
        self.words = [code[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.ids = [i for i, _ in items]
        self.chosen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.of_length: dict[int, list[int]] = defaultdict(list)
        self.shared = {n: np.zeros(1 << BITS, np.uint64) for n in (2, 3)}  # a bit per item length, by turns
        for k, words in enumerate(self.words):
            if len(words) >= LEAST:
                self.of_length[len(words)].append(k)
        self.lengths = sorted(self.of_length)
        self.bit = {m: np.uint64(1 << (k % 64)) for k, m in enumerate(self.lengths)}
        for m, own in self.of_length.items():
            for n, marks in self.shared.items():
                for k in own:
                    marks[self.slot(self.words[k], n)] |= self.bit[m]
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m, own in self.of_length.items():
            joined = np.concatenate([self.words[k] for k in own])
            keys = self.embed(joined, np.arange(len(own)) * m, np.arange(1, len(own) + 1) * m, m).ravel()
            item = np.repeat(np.array(own), walks * tables)
            order = np.argsort(keys, kind="stable")
            self.keys[m] = keys[order], item[order]

    @staticmethod
    def slot(words: np.ndarray, n: int) -> np.ndarray:
        last = len(words) - n + 1
        return (T.chained([words[k : k + max(last, 0)] for k in range(n)]) >> np.uint64(64 - BITS)).astype(np.int64)

    def marked(self, row: np.ndarray, words: np.ndarray) -> dict[int, np.ndarray]:
        """For each word, the item lengths that have the pair and the triple which begins there."""
        out = {}
        for n, marks in self.shared.items():
            out[n] = np.zeros(len(words), np.uint64)
            if len(words) >= n:
                whole = row[n - 1 :] == row[: len(row) - n + 1]
                out[n][: len(whole)] = np.where(whole, marks[self.slot(words, n)], np.uint64(0))
        return out

    def choices(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Random bits of the walks, (walks, steps), and the sampled steps of each table, (walks, tables, samples)."""
        if m not in self.chosen:
            rng, steps = np.random.default_rng([SEED, m]), 2 * m
            turn = rng.integers(1, 1 << 63, (self.walks, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            order = np.argsort(rng.random((self.walks, self.tables, steps)), axis=2)[:, :, : self.samples]
            self.chosen[m] = turn, np.sort(order, axis=2)
        return self.chosen[m]

    def embed(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray, m: int) -> np.ndarray:
        """Table keys (windows, walks * tables) of windows of ``m`` words from ``start``, padded past ``stop``."""
        stop = np.minimum(stop, start + m)
        turn, chosen = self.choices(m)
        padded = np.append(words, np.uint64(0))
        at = np.repeat(start[None, :], self.walks, axis=0)
        seen = []
        for t in range(int(chosen.max()) + 1):
            on = at < stop
            word = padded[np.where(on, at, len(words))]
            seen.append(word)
            at += on & ((word * turn[:, t : t + 1]) >> np.uint64(63) == 1)
        steps = np.stack(seen)  # (steps, walks, windows)
        number = np.arange(1, self.walks * self.tables + 1, dtype=np.uint64).reshape(self.walks, self.tables)
        walk = np.arange(self.walks)[:, None]
        keys = T.chained([np.broadcast_to(number[:, :, None], (*number.shape, len(start))), *[steps[chosen[:, :, k], walk] for k in range(chosen.shape[2])]])
        return keys.reshape(-1, len(start)).T

    def groups(self) -> list[list[int]]:
        """Item lengths in groups of near sizes, so that the pair count is taken once a group."""
        out: list[list[int]] = []
        for m in self.lengths:
            if out and m <= 1.3 * out[-1][0]:
                out[-1].append(m)
            else:
                out.append([m])
        return out

    def search(self, row: np.ndarray, words: np.ndarray) -> dict[tuple[int, int], int]:
        """(row, item) to edits of everything found."""
        n = len(words)
        if not n or not self.lengths:
            return {}
        stop = np.searchsorted(row, row, "right")
        marks = self.marked(row, words)
        need = {m: {k: m - k + 1 - k * budget(m, self.share) for k in self.shared} for m in self.lengths}

        def holds(begin: np.ndarray, size: int, bits: np.uint64, least: dict[int, int], at: np.ndarray, last: np.ndarray) -> np.ndarray:
            """Those of ``begin`` whose next ``size`` words, at ``at`` of the marks, hold enough shared pairs and triples."""
            for k, few in least.items():
                total = np.concatenate([[0], np.cumsum((marks[k][at] & bits) != 0)])
                end = np.maximum(np.minimum(begin + size, last[begin]) - k + 1, begin)
                begin = begin[total[end] - total[begin] >= few]
            return begin

        met: dict[tuple[int, int], list[int]] = defaultdict(list)
        every = np.arange(n)
        for group in self.groups():
            most = group[-1] + budget(group[-1], self.share)
            bits = np.bitwise_or.reduce([self.bit[m] for m in group])
            begin = holds(every, most, bits, {k: min(need[m][k] for m in group) for k in (3, 2)}, every, stop)
            # What follows looks at the words of these windows only.
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, begin, 1)
            np.add.at(edges, np.minimum(begin + most, stop[begin]), -1)
            near = np.flatnonzero(np.cumsum(edges[:n]))
            place = np.searchsorted(near, begin)
            last = np.searchsorted(near, stop[near])
            for m in group if len(begin) else ():
                start = near[holds(place, m + budget(m, self.share), self.bit[m], need[m], near, last)]
                if not len(start):
                    continue
                keys, (known, item) = self.embed(words, start, stop[start], m), self.keys[m]
                low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                hit, table = np.nonzero(high > low)
                many = (high - low)[hit, table]
                flat = np.repeat(low[hit, table] - np.cumsum(many) + many, many) + np.arange(many.sum())
                both = np.unique(np.stack([np.repeat(hit, many), item[flat]], axis=1), axis=0)
                for i, found in both.tolist():
                    met[int(row[start[i]]), found].append(int(start[i]))
        return self.verified(met, row, words)

    def verified(self, met: dict[tuple[int, int], list[int]], row: np.ndarray, words: np.ndarray) -> dict[tuple[int, int], int]:
        out = {}
        for (r, k), starts in met.items():
            m = len(self.words[k])
            edits, item = budget(m, self.share), self.words[k].tolist()
            first, end = np.searchsorted(row, [r, r + 1])
            starts = sorted(set(starts))
            best, at = m, 0
            while at < len(starts) and best:
                to = at
                while to + 1 < len(starts) and starts[to + 1] - starts[to] <= m:
                    to += 1
                a, b = max(int(first), starts[at] - edits), min(int(end), starts[to] + m + edits)
                best = min(best, distance(item, words[a:b].tolist()))
                at = to + 1
            if best <= edits:
                out[r, k] = best
        return out


def blocks(benchmark: DataFrame, most_items: int = BLOCK_ITEMS, most_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items (item_id, text) in blocks of about the given size; null texts are left out."""
    items = benchmark.where("text IS NOT NULL").select("item_id", F.col("text").cast("string").alias("text"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    number = max(-(-n // most_items), -(-size // most_bytes))
    for k in range(number):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k)
        yield [(r.item_id, r.text) for r in own.collect()]


def _searched(index: Index, column: pa.Array) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    for a, b in T.pieces(column):
        yield a, index.search(*letters(column.slice(a, b - a)))


def find(docs: DataFrame, benchmark: DataFrame, share: float = EDITS) -> DataFrame:
    """HITS: one row per document row and item found in it, with the smallest number of edits."""
    out = docs.sparkSession.createDataFrame([], HITS)
    for items in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items, share)
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("item_words", pa.int32())])
            for batch in batches:
                for a, hits in _searched(index, batch.column(1)):
                    rows = [(batch.column(0)[a + r].as_py(), index.ids[k], n, len(index.words[k])) for (r, k), n in hits.items()]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        out = out.unionByName(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, HITS))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, share: float = EDITS) -> DataFrame:
    """The documents in which no item is found, with all their columns. Null and empty texts stay."""
    out, names, schema = docs, docs.columns, docs.schema
    for items in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items, share)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, hits in _searched(index, batch.column(names.index("text"))):
                    keep[[a + r for r, _ in hits]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, schema)
    return out
