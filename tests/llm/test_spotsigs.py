import hashlib
import re

import numpy as np
import pyarrow as pa

from rowforge.llm import spotsigs as S
from rowforge.llm import text as T

LOWER = {c: c + 32 for c in range(65, 91)}


def one(word):
    return int(T.words(pa.array([word]), T.FOLDED, T.SYMBOLS).hash[0])


def brute(text):
    """Signatures in plain Python, from the same word hashes."""
    tokens = [w for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text)]
    tokens = [w.translate(LOWER) for w in tokens]
    content = [k for k, w in enumerate(tokens) if w not in S.ANCHORS]
    out = set()
    for k, w in enumerate(tokens):
        if w in S.ANCHORS and len(rest := [c for c in content if c > k]) >= S.CHAIN:
            out.add(int(T.chained([np.array([one(x)], np.uint64) for x in [w, *[tokens[c] for c in rest[: S.CHAIN]]]])[0] >> np.uint64(32)))
    return out


def parsed(fp):
    return {int(fp[k : k + 8], 16) for k in range(0, len(fp), 8)}


TEXTS = [
    "The quick brown fox of the red hill", "the the quick", None, "", "no anchors here", "le chât blanc et la souris verte", "a b c", "😀 the, «big» dog; runs",
    "the quick brown fox of the red hill", "x" * 50_000, "The and " * 20_000, "of Mice and Men the end of it all here",
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint int, _part string")


def test_signatures_against_brute_force():
    texts = [t for t in TEXTS if t and len(t) < 1000]
    got = dict(enumerate([parsed(h) for h in S.hexed(S.signatures(pa.array(texts), S.anchor_hashes()), len(texts))]))
    for k, t in enumerate(texts):
        assert not brute(t) and len(got[k]) == 1 or got[k] == brute(t)


def test_contract(spark):
    ids = [50, 3, 9, 2, 77, 5, 60, 61, 4, 100, 101, 102]
    rows = [(i, t, 1, "x") for i, t in zip(ids, TEXTS, strict=True)]
    for parts in (1, 4, 40):
        got = {r.doc_id: r for r in S.compare_with_next(frame(spark, rows), parts).collect()}
        order = sorted(ids)
        text = {i: t or "" for i, t, *_ in rows}
        assert sorted(got) == order
        for k, i in enumerate(order):
            t, n = text[i], text[order[(k + 1) % len(order)]]
            half = len(t) // 2
            e = t[: len(t) - half] + n[:half]
            a, b, c = parsed(got[i].fingerprint), parsed(got[i].edited_fingerprint), parsed(got[order[(k + 1) % len(order)]].fingerprint)
            assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 1e-12 and abs(got[i].near_next - len(a & c) / len(a | c)) < 1e-12
            assert (got[i].fingerprint == got[i].edited_fingerprint) or t != e
        assert got[50].fingerprint == got[4].fingerprint


def test_odd_rows(spark):
    assert S.compare_with_next(frame(spark, [])).count() == 0
    one = S.compare_with_next(frame(spark, [(1, "the big dog runs", 1, "x")])).first()
    assert one.near_next == 1 and one.n_chars == 16
    rows = [(None, "the big dog", 1, "x"), (None, None, 1, "x"), (7, "the big dog", 1, "x"), (7, "the big dog", 1, "x")]
    assert S.compare_with_next(frame(spark, rows), 3).count() == 4


def test_near_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(120):
        base = [f"{v:08x}" for v in range(1000 * (k // 12), 1000 * (k // 12) + int(rng.integers(5, 60)))]
        rows.append((k, "".join(sorted(set(base) - set(rng.choice(base, rng.integers(0, 4)))))))
    rows = [r for r in rows if r[1]]
    got = {(r.left, r.right) for r in S.near_pairs(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    first = {}
    for k, f in rows:
        first.setdefault(f, k)
    sets = {k: parsed(f) for f, k in first.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    assert got == want and want
