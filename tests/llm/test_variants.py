import random
import re
import zlib
from collections import Counter

import pytest

from rowforge.llm import variants


def brute_words(rows):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 199 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            seen[low] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute(words):
    out, forms = {}, {}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * words[w] else None
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, words[w], len(near[w]), words[forms[w]] if forms[w] else None)
    return out


def found(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def words_frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize("seed", range(3))
def test_groups_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = {"aaaaaa": 5, "aaaaaaa": 40, "aaaaaaaa": 300, "abaaaa": 9, "zzzzzz": 5, "éàöÿßü": 25, "éàöÿßüü": 5, "éàöÿß÷": 125, "z" * 3000: 5, "z" * 2999 + "y": 30, "z" * 3001: 5}
    while len(words) < 400:
        word = "".join(rng.choice("abé") for _ in range(rng.randint(6, 8)))
        words[word] = rng.choice([5, 6, 7, 25, 35, 130, 700, 4000])
    assert found(variants.group(words_frame(spark, words))) == brute(words)


def test_ranges_share_nodes(spark):
    """Every range opens with a word whose prefixes and suffixes lie in the range before."""
    words = {"common" + a + b + "ending": 5 + 30 * (a == "m") + 400 * (a + b == "mm") for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = found(variants.group(words_frame(spark, words)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == brute(words)
    assert {r[3] for r in got.values()} == {30}


def test_words_of_documents(spark):
    rng = random.Random(5)
    base = ["Hallöchen", "straße", "tomorrow", "tomorow", "necessary", "neccessary", "short", "ÀÉÎabc", "a×b÷cdef", "İstanbul"]
    rows = [(k, " ".join(rng.choices(base, k=60))) for k in range(300)] + [(7, "tomorrow " * 3), (7, "tomorrow " * 3), (None, "tomorrow Necessary"), (None, "tomorrow"), (9, None), (10, ""), (11, "123 !!")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    words = brute_words(rows)
    assert "tomorro" in words or any(len(w) < 8 for w in words)
    assert found(variants.variants(docs)) == brute(words)


def test_long_text_and_empty_table(spark):
    rows = [(1, "longword " * 200_000 + "a" * 500_000)]
    assert found(variants.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(brute_words(rows))
    empty = variants.variants(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
