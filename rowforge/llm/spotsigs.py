"""SpotSigs: a document is the set of its spot signatures.

A spot is a common word (an anchor). Its signature is the anchor with the next ``CHAIN`` content words,
``STEP`` content words apart; common words and symbols between them don't count. A fingerprint is the
sorted set of 32-bit signature hashes in hex. A text without a complete chain is one signature of its whole
bytes, so equal texts have equal fingerprints and different ones differ. Null texts count as empty."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm import text as T

CHAIN = 2
STEP = 1
SIMILAR = 0.8
LAST = (1 << 63) - 1
# Common words of four languages, the anchors.
ANCHORS = (
    "the of and to in a is that it for on was are with as be by this at from or an not "
    "der die das und ist von mit zu den ein eine nicht auf im für sich es auch "
    "le la les et des un une est que qui dans pour sur pas du au en par "
    "el los las y de se una con por para del al lo como más"
).split()

FINGERPRINTS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def anchor_hashes(anchors: tuple[str, ...] | list[str] = tuple(ANCHORS)) -> np.ndarray:
    return np.unique(T.words(pa.array([" ".join(anchors)]), T.FOLDED, T.SYMBOLS).hash)


def signatures(column: pa.Array, anchors: np.ndarray, chain: int = CHAIN, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Row and 32-bit signatures, a sorted set per row; each row has at least one."""
    found = T.words(column, T.FOLDED, T.SYMBOLS)
    letters = T.SYMBOLS[found.data[found.start]] == 1
    row, code = found.row[letters], found.hash[letters]
    at = np.searchsorted(anchors, code)
    at[at == len(anchors)] = 0
    common = anchors[at] == code if len(anchors) else np.zeros(len(code), bool)
    content = np.flatnonzero(~common)
    spot = np.flatnonzero(common)
    first = np.searchsorted(content, spot)
    whole = first + (chain - 1) * step < len(content)
    spot, first = spot[whole], first[whole]
    if len(spot):
        inside = row[content[first + (chain - 1) * step]] == row[spot]
        spot, first = spot[inside], first[inside]
    rows, codes = row[spot], code[spot]
    if len(spot):
        codes = T.chained([codes, *[code[content[first + k * step]] for k in range(chain)]])
    bare = np.flatnonzero(np.bincount(rows, minlength=len(column)) == 0)
    if len(bare):
        sums, (_, down) = T.prefix_hash(found.data, T.EXACT), T.powers(len(found.data) + 1)
        a, b = found.offsets[bare], found.offsets[bare + 1]
        rows, codes = np.concatenate([rows, bare]), np.concatenate([codes, T.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))])
    return T.sets(rows, codes, 32)


def hexed(found: tuple[np.ndarray, np.ndarray], rows: int) -> list[str]:
    """Fingerprint strings: eight hex digits per signature."""
    every = found[1].astype(">u4").tobytes().hex()
    cut = np.searchsorted(found[0], np.arange(rows + 1)) * 8
    return [every[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fingerprint(docs: DataFrame, *keep: str, chain: int = CHAIN, step: int = STEP, anchors: tuple[str, ...] = tuple(ANCHORS)) -> DataFrame:
    """Kept columns and the ``fingerprint`` of each row's text."""
    schema = docs.select(*keep).schema.add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = anchor_hashes(anchors)
        for batch in batches:
            out = []
            for a, b in T.pieces(batch.column(0)):
                out += hexed(signatures(batch.column(0).slice(a, b - a), known, chain, step), b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], names=schema.fieldNames())

    return docs.select(F.col("text").cast("string").alias("_text_"), *keep).mapInArrow(run, schema)


def spread_in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text, _order, _part, _ghost) cut into ranges of doc_id, one partition each and sorted within.

    Each range ends with a ghost: the first row of the next range (after the last: of the first), so a task
    sees every row's successor. Only range bounds, at most ``parts``, pass the driver. Null ids come last;
    rows of one id are ordered by text."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LAST)).alias("_order"))
    cuts = rows.stat.approxQuantile("_order", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(c) for c in cuts if c < LAST})
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b < F.col("_order"))).cast("int")
    rows = rows.withColumn("_part", part)
    heads = sorted(rows.groupBy("_part").agg(F.min("_order").alias("_order")).collect())
    targets = [(heads[k - 1][0], heads[k][1]) for k in range(len(heads))]
    at = docs.sparkSession.createDataFrame(targets, "_target int, _head long")
    ghosts = (
        rows.join(F.broadcast(at), F.col("_order") == F.col("_head")).groupBy("_order", "_target")
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("bigint").alias("doc_id"), "text", "_order", F.col("_target").alias("_part"), F.lit(True).alias("_ghost"))
    )
    both = rows.select("doc_id", "text", "_order", "_part", F.lit(False).alias("_ghost")).unionByName(ghosts)
    return both.repartitionById(len(bounds) + 1, "_part").sortWithinPartitions("_ghost", "_order", "text")


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by as many first ones of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, parts: int | None = None, chain: int = CHAIN, step: int = STEP, anchors: tuple[str, ...] = tuple(ANCHORS)) -> DataFrame:
    """FINGERPRINTS of each document, its edited text and its successor by doc_id; one document succeeds itself."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = anchor_hashes(anchors)
        last: tuple[int | None, str] | None = None
        for batch in batches:
            for a, b in T.pieces(batch.column(1)):
                ids, texts = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
                if last is not None:
                    ids.insert(0, last[0])
                    texts.insert(0, last[1])
                last = ids[-1], texts[-1]
                n = len(ids) - 1
                if not n:
                    continue
                changed = [edited(texts[k], texts[k + 1]) for k in range(n)]
                own = signatures(pa.array(texts, pa.large_string()), known, chain, step)
                other = signatures(pa.array(changed, pa.large_string()), known, chain, step)
                stays, follows = own[0] < n, own[0] > 0
                mine, after = (own[0][stays], own[1][stays]), (own[0][follows] - 1, own[1][follows])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(hexed(mine, n)), pa.array(hexed(other, n)),
                        pa.array(T.jaccard(mine, other, n)), pa.array(T.jaccard(mine, after, n)),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return spread_in_order(docs, parts).select("doc_id", "text").mapInArrow(run, FINGERPRINTS)


def _signatures(fingerprint: str) -> Column:
    return F.filter(F.split(F.regexp_replace(fingerprint, "(.{8})", "$1,"), ","), lambda s: s != "")


def near_pairs(prints: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """left, right, likeness of fingerprints at least ``similar`` alike (prints: doc_id, fingerprint).

    Equal fingerprints are one class, named by its smallest doc_id. Classes are partitioned by set length:
    a set meets only sets of its own band or the next, as lengths further apart can't be that alike. Within a
    band, pairs share one of the rarest signatures of both (enough of them that no pair is lost), and the
    length and overlap bounds prune what is left before the exact likeness."""
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    sets = classes.select("id", _signatures("fingerprint").alias("sigs")).withColumn("n", F.size("sigs"))
    each = sets.select("id", "n", F.explode("sigs").alias("sig"))
    ranked = each.join(each.groupBy("sig").agg(F.count(F.lit(1)).alias("df")), "sig")
    order = F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("order")
    need = (F.col("n") - F.ceil(F.lit(similar) * F.col("n") - 1e-9) + 1).cast("int")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similar)) + 1e-9).cast("int")
    firsts = (
        ranked.groupBy("id", "n").agg(order)
        .select("id", "n", band.alias("band"), F.explode(F.slice("order.sig", F.lit(1), need)).alias("sig"))
    )
    left = firsts.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1, F.col("band") - 1)))
    a, b = left.alias("a"), firsts.alias("b")
    fits = (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.lit(similar) * F.greatest("a.n", "b.n") - 1e-9)
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.sig") == F.col("b.sig")) & fits).select(F.col("a.id").alias("left"), F.col("b.id").alias("right")).distinct()
    texts = sets.select("id", "sigs")
    met = pairs.join(texts.toDF("left", "x"), "left").join(texts.toDF("right", "y"), "right")
    shared = F.size(F.array_intersect("x", "y"))
    likeness = shared / (F.size("x") + F.size("y") - shared)
    return met.select("left", "right", likeness.alias("likeness")).where(F.col("likeness") >= similar - 1e-12)
