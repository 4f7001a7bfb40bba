"""Induced sorting of suffixes to a bounded depth, in numpy.

Suffixes are sorted by their first ``DEPTH`` bytes. Only the leftmost S suffixes are sorted by comparison; L
and S suffixes are induced from them in one pass up and one pass down the buckets. A bucket's queue takes
suffixes in the order of those that induce them, so each bucket is emptied in bulk."""

from __future__ import annotations

import numpy as np

DEPTH = 56


def keys(data: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> list[np.ndarray]:
    """Big-endian 8-byte words of the suffixes at ``at``; zeros stand after the end."""
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    return [np.ascontiguousarray(padded[at[:, None] + np.arange(k, k + 8)]).view(">u8").ravel().astype(np.uint64) for k in range(0, depth, 8)]


def types(data: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the next one. The last suffix counts as L."""
    n = len(data)
    rises = np.zeros(n, bool)
    rises[:-1] = data[:-1] < data[1:]
    equal = np.zeros(n, bool)
    equal[:-1] = data[:-1] == data[1:]
    decided = np.where(equal, n, np.arange(n))
    return rises[np.minimum.accumulate(decided[::-1])[::-1]]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order of their first ``DEPTH`` bytes; ties in no order."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    small = types(data)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    leftmost = leftmost[np.lexsort(keys(data, leftmost)[::-1])]
    cut = np.searchsorted(data[leftmost], np.arange(257))
    large: list[np.ndarray] = [np.zeros(0, np.int64)] * 256
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    queues[data[-1]].append(np.array([n - 1]))  # the last suffix is L and comes first in its bucket

    def induce(found: np.ndarray, want_small: bool, here: int) -> np.ndarray:
        """Queue the suffixes before ``found`` that are of the wanted type; those of this bucket are returned."""
        before = found[found > 0] - 1
        before = before[small[before] == want_small]
        symbol = data[before]
        own = before[symbol == here]
        rest = before[symbol != here]
        if len(rest):
            order = np.argsort(data[rest], kind="stable")
            rest = rest[order]
            bounds = np.flatnonzero(np.diff(data[rest])) + 1
            for part in np.split(rest, bounds):
                queues[data[part[0]]].append(part)
        return own

    for c in range(256):
        taken = []
        new = np.concatenate(queues[c]) if queues[c] else np.zeros(0, np.int64)
        queues[c] = []
        while len(new):
            taken.append(new)
            new = induce(new, False, c)
        large[c] = np.concatenate(taken) if taken else np.zeros(0, np.int64)
        induce(leftmost[cut[c] : cut[c + 1]], False, c)
    out: list[np.ndarray] = []
    for c in range(255, -1, -1):
        taken = []
        new = np.concatenate(queues[c]) if queues[c] else np.zeros(0, np.int64)
        queues[c] = []
        while len(new):
            taken.append(new)
            new = induce(new, True, c)
        smaller = np.concatenate(taken) if taken else np.zeros(0, np.int64)
        out.append(smaller)  # descending
        out.append(large[c][::-1])
        induce(large[c][::-1], True, c)
    return np.concatenate(out)[::-1]


def shares(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix but the first in ``order``, whether it has ``length`` bytes in common with the one before."""
    same = np.ones(max(len(order) - 1, 0), bool)
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    width = 1 << 18
    for a in range(0, len(same), width):
        now = np.flatnonzero(same[a : a + width]) + a
        for k in range(0, length, 8):
            span = np.arange(k, min(k + 8, length))
            equal = (padded[order[now + 1][:, None] + span] == padded[order[now][:, None] + span]).all(axis=1)
            same[now[~equal]] = False
            now = now[equal]
    return same
