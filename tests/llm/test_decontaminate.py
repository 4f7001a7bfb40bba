import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rowforge.llm import decontaminate as D


def brute_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[:], i
        for j, b in enumerate(words, 1):
            row[j] = min(last[j - 1] + (a != b), last[j] + 1, row[j - 1] + 1)
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=90), st.lists(st.integers(0, 3), max_size=60))
def test_distance(item, words):
    assert D.distance(item, words) == brute_distance(item, words)


def vocabulary(rng, n):
    return ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]


def edit(rng, words, k, vocab):
    words = list(words)
    for _ in range(k):
        at, kind = rng.integers(0, len(words)), rng.integers(0, 3)
        if kind == 0:
            words[at] = str(rng.choice(vocab))
        elif kind == 1:
            words.insert(at, str(rng.choice(vocab)))
        elif len(words) > 1:
            words.pop(at)
    return words


def test_recall_and_exactness_against_brute_force():
    rng = np.random.default_rng(5)
    vocab = vocabulary(rng, 400)
    items = [(k, " ".join(rng.choice(vocab, rng.integers(5, 60)))) for k in range(60)]
    index = D.Index(items)
    texts = []
    for k in range(300):
        item = items[k % 60][1].split()
        planted = edit(rng, item, int(rng.integers(0, D.budget(len(item)) + 3)), vocab)
        texts.append(" ".join([*rng.choice(vocab, 80), *planted, *rng.choice(vocab, 80)]))
    row, words = D.letters(pa.array(texts))
    got = index.search(row, words)
    want = {}
    for r in range(300):
        own = words[row == r].tolist()
        for k in {r % 60}:
            if (d := brute_distance(index.words[k].tolist(), own)) <= D.budget(len(index.words[k])):
                want[r, k] = d
    assert all(want.get(key) == d for key, d in got.items() if key[1] == key[0] % 60)
    assert len(want) > 150 and sum(key in got for key in want) >= 0.97 * len(want)


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, item_id int, text string, edits string"),
        spark.createDataFrame(items, "item_id long, text string, doc_id int"),
    )


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def test_hits_and_removal(spark):
    docs = [
        (1, 0, "x y " * 30 + ITEM.upper().replace(" ", ", ") + " z " * 30, "e"), (2, 0, ITEM.replace("six ", "").replace("nine", "NEUF"), "e"), (3, 0, " ".join(ITEM.split()[:6]), "e"),
        (4, 0, None, "e"), (5, 0, "", "e"), (None, 0, ITEM, "e"), (6, 0, ITEM, "e"), (6, 0, ITEM, "e"), (7, 0, "clean " * 100_000, "e"), (8, 0, " ".join(reversed(ITEM.split())), "e"),
    ]
    items = [(10, ITEM, 1), (11, None, 1), (12, "", 1), (13, "clean", 1), (14, ITEM, 1), (None, "a b c d e f g", 1)]
    d, b = frames(spark, docs, items)
    got = sorted((tuple(r) for r in D.find(d, b).collect()), key=str)
    want = [(i, k, e, 12) for i, e in ((1, 0), (2, 2), (None, 0), (6, 0), (6, 0)) for k in (10, 14)]
    assert got == sorted(want, key=str)
    left = D.remove(d, b)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7, 8]


def test_empty_tables(spark):
    d, b = frames(spark, [], [(1, ITEM, 1)])
    assert D.find(d, b).count() == 0 and D.remove(d, b).count() == 0
    d, b = frames(spark, [(1, 0, ITEM, "e")], [])
    assert D.find(d, b).count() == 0 and D.remove(d, b).count() == 1


def test_blocks_cover_all_items(spark):
    _, b = frames(spark, [], [(k, f"item {k}", 1) for k in range(500)])
    cut = list(D.blocks(b, 40))
    assert len(cut) == 13 and sorted(i for c in cut for i, _ in c) == list(range(500))


def test_exact_passages_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.find(docs, items).collect()}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    own = [(r.item_id, f" {plain(r.text)} ") for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in own if t in f" {plain(r.text)} "}
    assert want and want <= got and len(got) < 3 * len(want)
