import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowforge.llm import packing as P


def best_fit_decreasing(lengths, room):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=lambda k: gaps[k])] -= n
        else:
            gaps.append(room - n)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, opened = P.best_fit(counts, 40)
    used, ranks = defaultdict(list), defaultdict(set)
    for n, first, count, seq, offset in plan:
        for k in range(count):
            used[seq + k].append((offset, n))
            assert first + k not in ranks[n]
            ranks[n].add(first + k)
    assert {n: len(r) for n, r in ranks.items()} == counts and all(r == set(range(len(r))) for r in ranks.values())
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 40
    assert len(used) == opened == best_fit_decreasing(lengths, 40)


def test_runs_stay_few():
    rng = np.random.default_rng(3)
    counts = {n: int(c) for n, c in enumerate(rng.integers(0, 10**9, 2049)) if n and c}
    plan, opened = P.best_fit(counts)
    total = sum(n * c for n, c in counts.items())
    assert len(plan) < 200_000 and opened <= 1.02 * (total / 2048) + 1


def check(spark, rows, room=2048):
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, piece int, rank string"), room).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for doc_id, text, *_ in rows:
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % room or room
        bounds = [0, *range(first, len(ids) + 1, room)] if len(ids) > room else [0, len(ids)]
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    for r in got:
        want[tuple(r)[:5]] -= 1
    assert not any(want.values())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= room
    assert len(sequences) == best_fit_decreasing([r.length for r in got], room)
    return len(sequences)


def test_documents(spark):
    rows = [(r.doc_id, r.text, 1, "r") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, None, 1, "r"), (None, "", 1, "r"), (9000, "a b <|endoftext|> c", 1, "r"), (9001, "same text", 1, "r"), (9001, "same text", 1, "r")]
    rows += [(9002, "x" * 30_000, 1, "r"), (9003, " " * 20_000 + "\n\t 'll 12 é😀", 1, "r"), (9004, "word " * 2047, 1, "r"), (9005, "word " * 2048, 1, "r")]
    check(spark, rows)
    check(spark, rows[-9:], 16)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
