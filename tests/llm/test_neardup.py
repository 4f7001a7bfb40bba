import random
import re

import numpy as np

from rowforge.llm import neardup as N
from rowforge.llm.components import components


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n=4, percent=80):
    """doc_id, set size, component, kept, by comparing every pair of different sets."""
    sets = [shingle_set(t, n) for _, t, *_ in rows]
    names = {}
    for (i, *_), s in zip(rows, sets, strict=True):
        if i is not None:
            names[s] = min(i, names.get(s, i))
    distinct = [s for s in names if s]
    root = {i: i for i, *_ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, *_), s in zip(rows, sets, strict=True):
        if s and i is not None:
            a, b = sorted((find(i), find(names[s])))
            root[b] = a
    where = {}
    for k, s in enumerate(distinct):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in enumerate(distinct):
        for j in {j for x in s for j in where[x] if j < k}:
            if 100 * len(s & distinct[j]) >= percent * len(s | distinct[j]):
                a, b = sorted((find(names[s]), find(names[distinct[j]])))
                root[b] = a
    out = []
    for (i, *_), s in zip(rows, sets, strict=True):
        c = (find(names[s]) if s in names else None) if s else i
        out.append((i, len(s), c, c is None or i == c))
    return sorted(out, key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int, id string, component string")
    return sorted((tuple(r)[:4] for r in N.near_duplicates(docs, **how).collect()), key=str)


def group(rng, size, words, edits):
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2300)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if any(i in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_all_pairs(spark):
    rng = random.Random(3)
    texts = [t for size, words, edits in ((60, 80, 5), (25, 40, 3), (12, 200, 12), (9, 12, 1), (40, 120, 9), (5, 3, 0)) for t in group(rng, size, words, edits)]
    texts += [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += ["One two THREE four five", "one two\tthree\x0bfour five", "one two three four five", None, None, "", " \n", "a", "A", "a b", "x " * 50_000]
    rows = [(i, t, 1, "x", "y") for i, t in zip(rng.sample(range(10_000), len(texts)), texts, strict=True)]
    rows += [(None, texts[0], 1, "x", "y"), (None, "no id has this text at all", 1, "x", "y"), rows[5], rows[5]]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, words=5) == brute(rows, 5)


def test_documents_against_all_pairs(spark):
    rows = [(r.doc_id, r.text, 1, "x", "y") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    rows = [(k, t, 1, "x", "y") for k, t in enumerate(group(rng, 1500, 60, 1))]
    got = run(spark, rows)
    assert got == brute(rows) and sum(r[3] for r in got) < 30


def test_pairs_of_a_source_that_shares_a_passage(spark):
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(84)]
    rows = []
    for k in range(1000):
        own = [f"o{k}x{j}" for j in range(18)]
        rows.append((2 * k, " ".join(passage + own), 1, "x", "y"))
        if k % 10 == 0:  # a partner of about 0.84 likeness, the only one
            rows.append((2 * k + 1, " ".join(passage + own[:9] + [f"n{k}x{rng.random()}" for _ in range(8)]), 1, "x", "y"))
    got = run(spark, rows)
    assert sum(r[3] for r in got) == 1000 and got == brute(rows)


def test_nothing_depends_on_the_forest(spark):
    rng = random.Random(12)
    rows = [(k, t, 1, "x", "y") for k, t in enumerate(t for _ in range(30) for t in group(rng, 12, 70, 6))]
    assert run(spark, rows, trees=1) == brute(rows)


def test_hubs_and_neighbours_reach_over_tasks(spark):
    rows = [(0, 7, k, k, k) for k in range(4000)] + [(1, 7, 0, 0, 5000), (1, 7, 1, 1, 5001)]
    placed = spark.createDataFrame(rows, "tree int, region long, deeper long, met long, id long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        star = {(r.a, r.b) for r in N.hubs(placed).select("a", "b").collect()}
        near = {(r.a, r.b) for r in N.neighbours(placed).select("a", "b").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert star == {(h, k) for h in range(N.HUBS) for k in range(h + 1, 4000)} | {(5000, 5001)}
    assert near >= {(k, k + step) for step in range(1, N.NEIGHBOURS + 1) for k in range(4000 - step)}


def test_empty_table(spark):
    assert run(spark, []) == []
