import hashlib

import numpy as np
import pyarrow as pa

from rowforge.llm import substrings as S
from rowforge.llm import suffixes


def brute(rows, length=50):
    last = S.LAST
    texts = [(last if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for order, data in texts:
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            first[w] = min(order, first.get(w, last + 1))
    out = []
    for (order, data), (doc_id, *_) in zip(texts, rows, strict=True):
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < order:
                gone[p : p + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(data) else 0
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[: len(data)]])
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, row string, order string")
    return sorted((tuple(r) for r in S.remove_repeats(docs.repartition(5)).collect()), key=str)


def test_suffixes_against_plain_sort():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n = int(rng.integers(1, 300))
        data = rng.integers(0, int(rng.integers(1, 6)), n).astype(np.uint8)
        if trial % 3 == 0:
            data = np.tile(data[:7], n // 7 + 1)[:n]
        order, plain = suffixes.suffix_array(data), bytes(data)
        heads = [plain[i : i + suffixes.DEPTH].ljust(suffixes.DEPTH, b"\0") for i in order]
        assert sorted(order.tolist()) == list(range(n)) and heads == sorted(heads)
        same = [plain[i : i + 20].ljust(20, b"\0") == plain[j : j + 20].ljust(20, b"\0") for i, j in zip(order[:-1], order[1:], strict=True)]
        assert suffixes.shares(data, order, 20).tolist() == same


def test_every_window_has_one_anchor():
    texts = ["abc " * 30, "", "x" * 49, "y" * 50, "é" * 100, "The quick brown fox jumps over the lazy dog again and again " * 3]
    cuts = S.anchors(pa.array(texts))
    for k, t in enumerate(texts):
        windows = [p for a, b in zip(cuts.start[cuts.row == k], cuts.stop[cuts.row == k], strict=True) for p in range(a, b)]
        assert sorted(windows) == list(range(max(0, len(t.encode()) - 49)))


def test_packing():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 1000).astype(np.uint64))
    assert (S.unpacked(S.packed(values)) == values).all() and not len(S.unpacked(S.packed(values[:0])))


def test_random_texts_against_brute_force(spark):
    rng = np.random.default_rng(4)
    parts = ["".join(rng.choice(list("abcdé \n"), rng.integers(20, 130))) for _ in range(12)]
    rows = [(int(i), "".join(rng.choice(parts, rng.integers(0, 6))) + ("" if k % 3 else str(k)), 1, "r", "o") for k, i in enumerate(rng.permutation(90))]
    rows += [(5, rows[3][1], 1, "r", "o"), (5, rows[4][1], 1, "r", "o"), (None, rows[6][1], 1, "r", "o"), (None, parts[0] * 3, 1, "r", "o"), (None, parts[0] * 3, 1, "r", "o")]
    rows += [(1000, None, 1, "r", "o"), (1001, "", 1, "r", "o"), (1002, "q" * 49, 1, "r", "o"), (1003, "q" * 49, 1, "r", "o"), (1004, "q" * 300, 1, "r", "o"), (1005, "q" * 60, 1, "r", "o")]
    assert run(spark, rows) == brute(rows)


def test_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text, 1, "r", "o") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = run(spark, rows)
    assert got == brute(rows) and any(r[2] for r in got)


def test_long_text_and_many_copies(spark):
    rng = np.random.default_rng(6)
    long = "".join(rng.choice(list("abcdefgh "), 5_000_000))
    rows = [(1, "start " + long[4_190_000:4_200_000], 1, "r", "o"), (2, long, 1, "r", "o"), *[(k, "a line that very many documents share, word for word, all of it", 1, "r", "o") for k in range(10, 400)]]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[2][2:4] == (10_000, 1) and got[1][2] == 0 and got[10][2] == 0 and all(got[k][2] == got[k][1] for k in range(11, 400))


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
