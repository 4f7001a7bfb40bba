"""Words and window hashes of whole Arrow string columns, in numpy.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. Hashes are
polynomials modulo 2**64 over random values per byte, taken from prefix sums, then mixed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Byte classes: a word is a maximal run of one class other than 0.
WORDS = np.ones(256, np.uint8)
WORDS[[9, 10, 11, 12, 13, 32]] = 0
SYMBOLS = WORDS.copy()  # letters, digits and bytes of longer code points apart from symbols
SYMBOLS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
EXACT = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = EXACT.copy()
FOLDED[ord("A") : ord("Z") + 1] = EXACT[ord("a") : ord("z") + 1]

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` for i below ``n``."""
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (null: empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(column: pa.Array, most: int = 1 << 20, rows: int = 1 << 16, beside: pa.Array | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows whose bytes, with those of ``beside``, stay near ``most``, so that work arrays stay small. A longer row stands alone."""
    _, offsets = utf8(column)
    if beside is not None:
        offsets = offsets + utf8(beside)[1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, (to := min(to, len(column), at + rows))
        at = to


@dataclass
class Words:
    """Words of some rows: row, byte start and end in the joined bytes, hash."""

    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def first(self) -> np.ndarray:
        """Index of the first word of each row, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(len(self.offsets)), "left")


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values[byte] * BASE**position``, one more entry than bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def words(column: pa.Array, values: np.ndarray = FOLDED, classes: np.ndarray = WORDS) -> Words:
    data, offsets = utf8(column)
    kind = classes[data]
    inside = kind > 0
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        same = kind[1:] == kind[:-1]
        begins[1:] &= ~same
        ends[:-1] &= ~same
        full = offsets[:-1] < offsets[1:]
        begins[offsets[:-1][full]] = inside[offsets[:-1][full]]
        ends[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix_hash(data, values)
    _, down = powers(len(data) + 1)
    hashed = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(data, offsets, np.searchsorted(offsets, start, "right") - 1, start, end, hashed)


def chained(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for a sequence of hashes; their order counts."""
    out = hashes[0]
    for h in hashes[1:]:
        out = mix(out * np.uint64(BASE) + h)
    return out


def shingles(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each ``n``-word shingle, repeats included; fewer words give their whole sequence as one."""
    if not len(found.row):
        return found.row, found.hash
    first = found.first()
    count = np.diff(first)
    rows = [np.zeros(0, np.int64)]
    out = [np.zeros(0, np.uint64)]
    if len(found.row) >= n:
        whole = found.row[: len(found.row) - n + 1] == found.row[n - 1 :]
        at = np.flatnonzero(whole)
        rows.append(found.row[at])
        out.append(chained([found.hash[at + k] for k in range(n)]))
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        if len(short):
            rows.append(short)
            out.append(mix(chained([found.hash[first[short] + k] for k in range(size)]) + np.uint64(size)))
    return np.concatenate(rows), np.concatenate(out)


def sets(row: np.ndarray, value: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, top ``bits`` of value), sorted by both. Fewer bits sort faster and need rows below ``2**(64 - bits)``."""
    value = value >> np.uint64(64 - bits)
    if bits < 64:
        both = np.sort((row.astype(np.uint64) << np.uint64(bits)) | value)
        keep = np.ones(len(both), bool)
        keep[1:] = both[1:] != both[:-1]
        both = both[keep]
        return (both >> np.uint64(bits)).astype(np.int64), both & np.uint64((1 << bits) - 1)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def overlap(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the sizes of the intersection and the union of two sets as ``sets`` gives them."""
    sizes = np.bincount(left[0], minlength=rows) + np.bincount(right[0], minlength=rows)
    row, value = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    shared = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=rows)
    return shared, sizes - shared


def jaccard(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    """Likeness per row; 1 for two empty sets."""
    shared, union = overlap(left, right, rows)
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)
