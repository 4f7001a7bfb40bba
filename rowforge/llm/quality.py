"""Quality by importance resampling over hashed n-grams.

Two generative models share ``BUCKETS`` hashed features: the target model counts labelled good
documents, the raw model counts every document. A document's log weight is the sum over its features of
log(target / raw). A Gumbel variate per document is added and the k largest keys are kept: sampling
without replacement in proportion to the weights. k is the expected number of acceptances, the sum of
min(1, weight / bar); the bar is 1, or the weight that all but ``MISSED`` of the labelled good documents
reach where few labels make the weights uncertain.

Features are words and symbol runs (lower case), pairs of neighbours, and one shared feature for a word
followed by itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm import text as T
from rowforge.llm.ids import drop_keys
from rowforge.llm.store import stage

BUCKETS = 1 << 16
LABELLED = 50_000
PRIOR = 20.0
MISSED = 0.005  # share of the labelled good documents whose weight may lie under the accepted one
SEED = 17
BINS = 4096


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each feature. Null and empty texts have none."""
    found = T.words(column, T.FOLDED, T.SYMBOLS)
    single = found.hash % np.uint64(buckets)
    pair = found.row[1:] == found.row[:-1]
    left, right = found.hash[:-1][pair], found.hash[1:][pair]
    double = np.where(left == right, np.uint64(0), T.chained([left, right])) % np.uint64(buckets)
    return np.concatenate([found.row, found.row[1:][pair]]), np.concatenate([single, double]).astype(np.int64)


def labelled(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """Ids of at most ``most`` documents labelled good (quality 1), the same ones each time."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_good")).distinct()
    return good.orderBy(F.xxhash64("_good"), "_good").limit(most)


def marked(docs: DataFrame, labels: DataFrame, *keep: str, most: int = LABELLED) -> DataFrame:
    """Text, whether it is labelled good (1 or 0), and kept columns."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text_"), F.struct(F.lit(0), *keep).alias("_kept_"))
    joined = rows.join(F.broadcast(labelled(labels, most)), F.col("doc_id") == F.col("_good"), "left")
    return joined.select("_text_", F.col("_good").isNotNull().cast("int").alias("_is_good_"), *[F.col(f"_kept_.{c}") for c in keep])


def counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = LABELLED) -> DataFrame:
    """bucket, raw, target: feature counts of all documents and of the labelled good ones.

    Each task adds up its documents first, so what moves is at most one row per bucket and task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1)) == 1
            for a, b in T.pieces(batch.column(0)):
                row, bucket = features(batch.column(0).slice(a, b - a), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[a:b][row]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    parts = marked(docs, labels, most=most).mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def model(counted: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Raw and target counts per bucket. At most ``buckets`` rows reach the driver."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in counted.collect():
        raw[bucket], target[bucket] = r, t
    return raw, target


def log_weights(column: pa.Array, good: np.ndarray, raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Sum over each text's features of log(target / raw), both shrunk by ``prior`` features, the raw counts scaled
    to the target's total. A text's own features are left out of the counts it is judged by, or else what only it has
    would speak against it. 0 without features or without good documents."""
    out = np.zeros(len(column))
    if not target.sum():
        return out
    row, bucket = features(column, len(raw))
    both, n = np.unique(row * len(raw) + bucket, return_counts=True)
    row, bucket = both // len(raw), both % len(raw)
    scale = target.sum() / raw.sum()
    ratio = np.log((target[bucket] - good[row] * n + prior) / ((raw[bucket] - n) * scale + prior))
    return np.bincount(row, weights=n * ratio, minlength=len(column))


def weigh(docs: DataFrame, labels: DataFrame, raw: np.ndarray, target: np.ndarray, *keep: str) -> DataFrame:
    """Kept columns, ``good`` (1 where labelled so) and ``log_weight`` of each document."""
    schema = docs.select(*keep).schema.add("good", "integer").add("log_weight", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, good, out = batch.column(0), np.asarray(batch.column(1)), np.zeros(batch.num_rows)
            for a, b in T.pieces(column):
                out[a:b] = log_weights(column.slice(a, b - a), good[a:b], raw, target)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(1), pa.array(out)], names=schema.fieldNames())

    return marked(docs, labels, *keep).mapInArrow(run, schema)


def threshold(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of ``key``, by counting ever finer ranges; at most ``BINS`` counts come back a time."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0 or not n:
        return None
    if k >= n:
        return low
    above = 0  # rows over ``high``
    while True:
        width = (high - low) / BINS
        if width <= 0 or low + width == low or high - width == high:
            return low
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        found = inside.groupBy(place.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for _, n, first, last in sorted(found.collect(), reverse=True):
            if above + n >= k:
                low, high = first, last
                break
            above += n
        if low == high:
            return low


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, text hash, log_weight, key, kept of each document.

    Rows with a null id or equal rows are weighed like others; equal rows get equal keys, and rows tied
    with the k-th key are all kept. Without labels every weight is 1 and all are kept."""
    keyed = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    scored = stage(weigh(keyed, labels, *model(counts(docs, labels)), "doc_id", "_hash"), "importance")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_hash"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keys = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))
    reached = keys.where("good = 1").agg(F.percentile("log_weight", F.lit(MISSED))).first()[0]  # at most LABELLED rows
    bar = F.lit(min(0.0, reached or 0.0))
    expected = keys.agg(F.sum(F.exp(F.least(F.col("log_weight") - bar, F.lit(0.0))))).first()[0] or 0.0
    least = threshold(keys, int(round(expected)))
    return keys.drop("good").withColumn("kept", F.lit(False) if least is None else F.col("key") >= F.lit(least))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the resampling keeps, with all their columns."""
    key = lambda own: F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), own)
    gone = stage(resample(docs, labels).where("NOT kept").select(key(F.col("_hash")).alias("id")), "rejected")
    return drop_keys(docs, key(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))), gone)
