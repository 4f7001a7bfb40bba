import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rowforge.llm import phrases


def brute(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    f[lang][tuple(words[k : k + size])] += 1
    out = []
    for lang in n:
        often = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in often.items():
            score, k = min((2000000 * a // (f[lang][p[:k]] + f[lang][p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, "x") for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string")


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["of", "the", "New", "york", "city", "É", "é", "a b", "x'y", "-", "hall", "🙂"]
    ends = [" ", "  ", " \t", " ", " ", " ", ". ", ",", "\n", "\x0b", "!?", "\x1c"]
    rows = []
    for k in range(400):
        text = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 80)))
        if k % 3 == 0:
            text += " New York City hall" * 3 + "; rare%d word%d" % (k, k)
        rows.append((rng.choice(["en", "en", "de", "de", None, "und"]), text))
    rows += [("en", None), (None, ""), ("en", " \t"), ("fr", "....")] + [rows[5]] * 2
    want = brute(rows)
    assert len({r[0] for r in want}) == 3 and any(r[2].count(" ") == 3 for r in want)
    assert found(phrases.collocations(frame(spark, rows))) == want
    assert found(phrases.collocations(frame(spark, rows), top=3)) == brute(rows, top=3)


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    """A bitmap that marks every pair only makes windows longer."""
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60))) for _ in range(100)]
    monkeypatch.setattr(phrases, "marked", lambda hashes: np.full(4096, 255, np.uint8))
    assert found(phrases.collocations(frame(spark, rows))) == brute(rows)


def test_long_texts_are_cut_between_pieces():
    words = ["alpha beta gamma"] * 40
    for text in ("; ".join(words * 3000), " ".join(words * 3000), "é" * 3_000_000, ".." * 1_500_000):
        parts = [p.to_pylist() for _, p in phrases.chunks(pa.array(["short", text, None], pa.string()))]
        flat = [t or "" for p in parts for t in p]
        assert "".join(flat) == "short" + text
        assert all(t[-1] in "; ." for t in flat[1:-2] if len(t) > 5)


def test_long_text(spark):
    rows = [("en", "one two three four five. " * 60_000 + "six"), ("en", "one two " * 300_000)]
    assert found(phrases.collocations(frame(spark, rows))) == brute(rows)


def test_large_numbers_and_ties(spark):
    """Products pass 64 bits; of equal scores the first cut counts."""
    big = 3 * 10**15
    grams = spark.createDataFrame(
        [("en", 0, "", 9 * big), ("en", 1, "a", 2 * big), ("en", 1, "b", 2 * big), ("en", 1, "c", 2 * big), ("en", 2, "a b", big), ("en", 2, "b c", big), ("en", 3, "a b c", big - 1)],
        "lang string, size int, phrase string, f long",
    )
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases.scored(grams).collect()}
    assert got["a b"] == (big, 2 * big, 2 * big, 500000)
    assert got["a b c"] == (big - 1, 2 * big, big, 2000000 * (big - 1) // (3 * big))
    assert {r.phrase: r.longer for r in phrases.covered(grams).collect()} == {"a b": big - 1, "b c": big - 1}


def test_empty_table(spark):
    df = phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert df.count() == 0
    assert dict(df.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}
