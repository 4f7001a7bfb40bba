"""Near-duplicate documents with an LSH forest over MinHash signatures.

Documents are sets of word shingles. Equal sets are one class, so exact copies cost one row each. A class
has ``HASHES`` minima; each of ``TREES`` orders sorts all classes by a different sequence of them. Classes
whose labels agree in the first ``DEPTH`` minima lie in one region, and inside it the sort goes on to deeper
minima, so that in crowded regions the neighbours are those with the longest common prefix. The next
``NEIGHBOURS`` classes of the region are candidates. A second sort puts the classes that meet most others
first in their region: the origins of groups of copies. The first ``HUBS`` are candidates for all of it. The sort
is by range and ends with the id, and hubs are joined to rows: no region, of any size, is one task's work, and
candidates grow with the classes, not with the square of a region.

Links are confirmed on full shingle sets: first the best candidate of every class, then, as links within a
component change nothing, every candidate that still joins two components.

The forest only saves work; what it misses is found exactly. The shingles of a class are ranked, rarest first, by
hashed counts. The first shingle that two sets of the asked likeness share stands early in both: at most as many
others precede it as the pair may leave unshared. Classes of different components meet by that shingle only; of one
that a large component holds, only the other classes meet all. Such pairs have ``need`` shingles in common among the
first of both; those that do, and that lengths and ranks don't rule out, are confirmed as well."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowforge.llm import text as T
from rowforge.llm.components import components
from rowforge.llm.ids import Marks, drop_keys, select
from rowforge.llm.store import stage
from rowforge.operators.skew import attach

WORDS = 4
PERCENT = 80
HASHES = 64
TREES = 24
DEPTH = 4
DEEPER = 4
NEIGHBOURS = 3
HUBS = 4
SEED = 8
NEED, NEED_SHARE = 3, 32  # shared first shingles asked of a pair, and one more for so many shingles
BUCKETS = 1 << 20
SLICES = 64


def minima(row: np.ndarray, value: np.ndarray, rows: int, hashes: int = HASHES) -> np.ndarray:
    """(rows, hashes) 16-bit minima; zeros for rows without a value."""
    out = np.zeros((rows, hashes), np.uint16)
    if not len(row):
        return out
    rng = np.random.default_rng(SEED)
    turn = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)
    has, first = np.unique(row, return_index=True)
    value = T.mix(value)
    for k in range(hashes):
        least = np.minimum.reduceat((value * turn[k] + add[k]) >> np.uint64(20), first)
        out[has, k] = T.mix(least).astype(np.uint16)
    return out


def common(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """About how many rows hold the shingles of each bucket of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at, to in T.pieces(batch.column(0)):
                _, value = T.sets(*T.shingles(T.words(batch.column(0).slice(at, to - at)), words), 48)
                count += np.bincount((value % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        parts = [c.tobytes() for c in np.split(count, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS // SLICES, np.int64)
        for batch in batches:
            for c in batch.column("counts"):
                total += np.frombuffer(c.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema).groupBy("slice").applyInArrow(add, schema)
    out = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for k, counts in found.collect():  # SLICES rows
        out[k] = np.frombuffer(counts, np.int64)
    return np.minimum(out.ravel(), (1 << 32) - 1).astype(np.uint32)


def first_ones(size: np.ndarray, percent: int, smaller: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many first shingles of sets of a size to compare, with larger sets (``smaller``) or with smaller ones, and ``need``."""
    least = -(-2 * percent * size // (100 + percent)) if smaller else -(-percent * size // 100)
    need = np.minimum(NEED + size // NEED_SHARE, np.maximum(least, 1))
    return size - np.maximum(least, 1) + need, need


def describe(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set digest (a, b), minima and first shingles of each row; null and empty texts have the empty set."""
    ranks = docs.sparkSession.sparkContext.broadcast(common(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in T.pieces(batch.column(1)):
                n = to - at
                row, value = T.sets(*T.shingles(T.words(batch.column(1).slice(at, n)), words), 48)
                count = np.bincount(row, minlength=n)
                digest = []
                cut = np.searchsorted(row, np.arange(n + 1))
                for salt in (1, 2):
                    sums = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(T.mix(value * np.uint64(2) + np.uint64(salt << 60)), out=sums[1:])
                    digest.append((sums[cut[1:]] - sums[cut[:-1]]).astype(np.int64))
                signs = minima(row, value, n)
                rank = (row.astype(np.uint64) << np.uint64(32)) | ranks.value[(value % np.uint64(BUCKETS)).astype(np.int64)]
                ranked = value[np.argsort(rank, kind="stable")].astype(np.int64)
                most, _ = first_ones(count, percent, False)
                first = [ranked[a : a + m].tobytes() if c else b"" for a, m, c in zip(cut[:-1].tolist(), most.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(count), *map(pa.array, digest), pa.array([s.tobytes() for s in signs], pa.binary()), pa.array(first, pa.binary())],
                    names=["doc_id", "n_shingles", "a", "b", "minima", "first"],
                )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, a long, b long, minima binary, first binary")


def forest(classes: DataFrame, trees: int = TREES) -> DataFrame:
    """tree, region, deeper, met, id: each class (id, minima, met) in every sorted order."""
    rng = np.random.default_rng(SEED + 1)
    orders = [rng.permutation(HASHES)[: DEPTH + DEEPER] for _ in range(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, HASHES).astype(np.uint64)
            for tree, order in enumerate(orders):
                label = [sum(signs[:, c] << np.uint64(16 * (3 - k)) for k, c in enumerate(part)).astype(np.int64) for part in (order[:DEPTH], order[DEPTH:])]
                columns = [pa.array(np.full(batch.num_rows, tree, np.int32)), *map(pa.array, label), batch.column(2), batch.column(0)]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "region", "deeper", "met", "id"])

    return classes.select("id", "minima", "met").mapInArrow(run, "tree int, region long, deeper long, met long, id long")


def neighbours(placed: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """a < b with the number of orders in which they are next to each other in a region.

    Tasks also give the first and last classes of their range, a few each, which are compared across the ranges."""
    keys = ["tree", "region", "deeper", "id"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 4
        seen = 0
        edge = lambda rows: pa.RecordBatch.from_arrays([pa.nulls(len(rows[0]), pa.int64())] * 2 + [pa.array(c).cast(t) for c, t in zip(rows, kinds, strict=True)], names=["a", "b", *keys])
        for batch in batches:
            now = [np.asarray(batch.column(k)).astype(np.int64) for k in range(4)]
            if seen < most:
                yield edge([c[: most - seen] for c in now])
            seen += batch.num_rows
            tree, region, deeper, ident = (np.concatenate([old, new]) for old, new in zip(last, now, strict=True))
            left, right = [], []
            for step in range(1, most + 1):
                near = (tree[step:] == tree[:-step]) & (region[step:] == region[:-step])
                near[: max(0, len(last[0]) - step)] = False  # seen with the batch before
                left.append(ident[:-step][near])
                right.append(ident[step:][near])
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *[pa.nulls(len(a), t) for t in kinds]], names=["a", "b", *keys])
            last = [c[-most:] for c in (tree, region, deeper, ident)]
        yield edge(last)

    ordered = placed.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = ordered.mapInArrow(run, "a long, b long, tree int, region long, deeper long, id long").groupBy("a", "b", *keys).agg(F.count(F.lit(1)).alias("trees"))
    found = stage(found, "ordered")
    order = Window.partitionBy("tree", "region").orderBy("deeper", "id")
    after = F.array(*[F.lead("id", k).over(order) for k in range(1, most + 1)])
    edges = found.where("tree IS NOT NULL").withColumn("_after", after).select("id", F.explode("_after").alias("next")).where("next IS NOT NULL")
    across = edges.select(F.least("id", "next").alias("a"), F.greatest("id", "next").alias("b"), F.lit(1).cast("long").alias("trees"))
    both = found.where("tree IS NULL").select("a", "b", "trees").unionByName(across)
    return both.where("a <> b").groupBy("a", "b").agg(F.sum("trees").alias("trees"))


def hubs(placed: DataFrame, most: int = HUBS) -> DataFrame:
    """a < b for each class of a region with the first of it that meet most others.

    The first ones are cut within each task before they move, and are joined to all rows of their region, however many tasks hold it."""
    first = placed.withColumn("_n", F.row_number().over(Window.partitionBy("tree", "region").orderBy("met", "id"))).where(F.col("_n") <= most)
    heads = first.groupBy("tree", "region").agg(F.collect_list("id").alias("_heads")).where(F.size("_heads") > 1)
    met = attach(placed, heads, ["tree", "region"], "inner").select("id", F.explode("_heads").alias("_head")).where("id <> _head")
    return met.select(F.least("id", "_head").alias("a"), F.greatest("id", "_head").alias("b"))


def candidates(classes: DataFrame, trees: int = TREES) -> DataFrame:
    """a < b with the number of orders in which they are candidates."""
    near = neighbours(forest(classes.withColumn("met", F.lit(0).cast("long")), trees))
    near = stage(near, "neighbours")
    side = lambda c: near.groupBy(F.col(c).alias("id")).agg(F.sum("trees").alias("n"))
    met = side("a").unionByName(side("b")).groupBy("id").agg((-F.sum("n")).alias("met"))
    star = hubs(forest(classes.join(met, "id"), trees)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("trees"))
    return near.unionByName(star).groupBy("a", "b").agg(F.sum("trees").alias("trees"))


def meeting(sets: DataFrame, known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, _a, _b: pairs of different components among ``sets`` (id, n, first), once for each shingle that may be the rarest they share.

    ``known`` (id, component) has the components; other sets are their own. Where I is the least intersection of sets
    of sizes n and m that are ``percent`` alike, the rarest shared one has at most n - I shingles of its set before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(1)).astype(np.int64)
            (small, need), (large, most) = first_ones(n, percent, True), first_ones(n, percent, False)
            early, size = small - need, large - most + 1
            data = [np.frombuffer(b.as_py(), np.int64)[:m] for b, m in zip(batch.column(2), size.tolist(), strict=True)]
            if not len(data):
                continue
            row = np.repeat(np.arange(len(size)), size)
            rank = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            shingle = np.concatenate(data)
            for a in range(0, len(row), 1 << 16):
                own, k = row[a : a + (1 << 16)], rank[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingle[a : a + (1 << 16)]), batch.column(0).take(pa.array(own)), pa.array(n[own]), pa.array(k), pa.array(k <= early[own]), batch.column(3).take(pa.array(own))],
                    names=["g", "id", "n", "rank", "early", "c"],
                )

    named = sets.join(known, "id", "left").select("id", "n", "first", F.coalesce("component", "id").alias("component"))
    firsts = named.mapInArrow(run, "g long, id long, n long, rank long, early boolean, c long")
    ends = firsts.groupBy("g").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).where("_low < _high").select("g")
    met = stage(attach(firsts, ends, ["g"], "inner"), "shared")
    sizes = met.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k"))
    major = sizes.groupBy("g").agg(F.max_by("c", F.struct("k", "c")).alias("_major"))
    told = stage(attach(met, major, ["g"]).withColumn("minor", F.expr("c <> _major")).drop("_major"), "shared")
    x, y = told.where("early").alias("x"), told.alias("y")
    fits = F.expr(f"x.g = y.g AND x.c <> y.c AND (x.n < y.n OR x.n = y.n AND x.id < y.id) AND 100 * x.n >= {percent} * y.n")
    first = F.expr(f"least(x.n - x.rank, y.n - y.rank) >= ceil({percent} * (x.n + y.n) / {100 + percent} - 1e-6)")
    of = lambda left, right: left.join(right, fits & first).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.c").alias("_a"), F.col("y.c").alias("_b"))
    return of(x.where("minor"), y).unionByName(of(x.where("NOT minor"), y.where("minor")))


def left_over(sets: DataFrame, known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, _a, _b: every pair of ``meeting`` that may be ``percent`` alike by the number of first shingles they share and by what follows the last of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (np.asarray(batch.column(k)).astype(np.int64) for k in ("n_a", "n_b"))
            _, need = first_ones(n, percent, True)
            least = -(-percent * (n + m) // (100 + percent))
            fits = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("first_a"), batch.column("first_b"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.int64)[: n[k] - least[k] + need[k]], np.frombuffer(y.as_py(), np.int64)[: m[k] - least[k] + need[k]]
                shared, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                fits[k] = len(shared) >= need[k] and len(shared) + min(n[k] - i.max() - 1, m[k] - j.max() - 1) >= least[k]
            yield batch.select(["a", "b", "_a", "_b"]).filter(pa.array(fits))

    pairs = stage(meeting(sets, known, percent).distinct(), "met")
    few = stage(select(sets.select("id", "n", "first"), F.col("id"), ends_of(pairs), True).select("id", "n", "first"), "met-sets")
    side = lambda c: few.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("first").alias(f"first_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, _a long, _b long")


def ends_of(pairs: DataFrame) -> Marks:
    side = lambda c: pairs.select(F.col(c).alias("id")).distinct()
    return Marks(stage(side("a").unionByName(side("b")).distinct(), "ids"))


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, text of the documents in ``pairs``, and of few others."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return select(rows, F.col("doc_id"), ends_of(pairs), True).select("doc_id", "text")


def alike(batches: Iterator[pa.RecordBatch], words: int = WORDS, percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """a, b of the rows (a, b, x, y) whose texts are ``percent`` alike. A short text may meet a long one, so both sides bound a piece."""
    for batch in batches:
        for at, to in T.pieces(batch.column(2), 1 << 21, beside=batch.column(3)):
            n = to - at
            x, y = (T.sets(*T.shingles(T.words(batch.column(k).slice(at, n)), words)) for k in (2, 3))
            shared, union = T.overlap(x, y, n)
            yield batch.select(["a", "b"]).slice(at, n).filter(pa.array((union > 0) & (100 * shared >= percent * union)))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full shingle sets satisfy ``100 * intersection >= percent * union``."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return met.mapInArrow(lambda batches: alike(batches, words, percent), "a long, b long")


def merged(known: DataFrame, pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """id, component with the links of ``pairs`` (a, b, and their components _a, _b) added to ``known``."""
    links = confirmed(pairs, texts, words, percent).join(pairs, ["a", "b"]).select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    more = components(links).select(F.col("id").alias("component"), F.col("component").alias("_last"))
    final = known.join(more, "component", "left").select("id", F.coalesce("_last", "component").alias("component"))
    alone = more.join(known.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), F.col("_last").alias("component"))
    return stage(final.unionByName(alone), "components")


def best_of(pairs: DataFrame) -> DataFrame:
    """a, b: for each end of ``pairs`` (a, b, trees) the pair of most orders, then of the smallest ids. Each side is grouped before they meet."""
    most = F.max(F.struct("trees", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("p")
    side = lambda c: pairs.groupBy(F.col(c).alias("v")).agg(most)
    best = side("a").unionByName(side("b")).groupBy("v").agg(F.max("p").alias("p"))
    return best.select((-F.col("p.a")).alias("a"), (-F.col("p.b")).alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and set digest (a, b) of every row.

    ``component_id`` is the smallest doc_id reachable over links. Rows without a word are linked with nothing.
    Rows that share a doc_id are one document to links. A row without an id belongs to the class of its set;
    where that has no id either, component_id is null and the row is kept."""
    rows = stage(describe(docs, words, percent), "shingles")
    full = rows.where("n_shingles > 0")
    classes = full.groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("minima").alias("minima"), F.first("first").alias("first"))
    classes = stage(classes, "classes")
    named = classes.where("id IS NOT NULL")
    pairs = stage(candidates(named.select("id", "minima"), trees), "candidates")
    texts = stage(texts_of(docs, pairs), "texts")
    best = best_of(pairs)
    first = components(confirmed(stage(best, "best"), texts, words, percent))
    first = stage(first, "components")
    of = lambda c: first.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
    told = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("_a", F.coalesce("_a", "a")).withColumn("_b", F.coalesce("_b", "b"))
    open_pairs = stage(told.where("_a <> _b").select("a", "b", "_a", "_b"), "open")
    second = merged(first, open_pairs, texts, words, percent)
    rest = stage(left_over(named.select("id", F.col("n_shingles").alias("n"), "first"), second, percent), "rest")
    third = merged(second, rest, stage(texts_of(docs, rest), "texts"), words, percent)
    facts = named.join(third, "id", "left").select("a", "b", "n_shingles", F.coalesce("component", "id").alias("_component"))
    found = attach(full.drop("minima", "first"), facts, ["a", "b", "n_shingles"])
    bare = rows.where("n_shingles = 0").drop("minima", "first").withColumn("_component", F.col("doc_id"))
    every = found.unionByName(bare)
    kept = F.col("_component").isNull() | F.coalesce(F.col("doc_id") == F.col("_component"), F.lit(False))
    return every.select("doc_id", "n_shingles", F.col("_component").alias("component_id"), kept.alias("kept"), "a", "b")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns; of repeated rows of one id, one stays."""
    found = near_duplicates(docs, words, percent)
    ids = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    told = stage(ids.where("NOT kept OR n > 1"), "gone")
    return drop_keys(docs, F.col("doc_id"), told.where("NOT kept").select("id"), told.where("kept").select("id"))
