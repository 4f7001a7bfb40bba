import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowforge.llm import quality


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, _good int, key int")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_features_are_words_symbols_and_pairs():
    row, bucket = quality.features(pa.array(["A b!!", None, "", "b b b", "é\tA"]))
    assert Counter(row.tolist()) == {0: 5, 3: 5, 4: 3} and (bucket[row == 3] == 0).sum() == 2
    again = quality.features(pa.array(["a B !!"]))[1]
    assert sorted(again) == sorted(bucket[row == 0])


def test_weights_against_plain_python(spark):
    texts = {k: " ".join(f"w{(k * j) % 7}" for j in range(k + 1)) + ("%%%" if k % 3 == 0 else "") for k in range(40)}
    good = {k: int(k % 3 > 0) for k in range(30)}
    d, lab = docs(spark, [(k, t, "x", 1, 2) for k, t in texts.items()]), labels(spark, [(k, q, 0) for k, q in good.items()])
    raw, target = Counter(), Counter()
    found = {k: quality.features(pa.array([t]))[1].tolist() for k, t in texts.items()}
    for k, f in found.items():
        raw.update(f)
        target.update(f if good.get(k) else [])
    share = sum(target.values()) / sum(raw.values())
    ratio = lambda k, b, n: math.log((target[b] - n * good.get(k, 0) + quality.PRIOR) / ((raw[b] - n) * share + quality.PRIOR))
    want = {k: sum(n * ratio(k, b, n) for b, n in Counter(f).items()) for k, f in found.items()}
    got = quality.resample(d, lab).collect()
    assert all(abs(r.log_weight - want[r.doc_id]) < 1e-9 for r in got)
    bar = min(0, np.quantile([w for k, w in want.items() if good.get(k)], quality.MISSED))
    k = round(sum(math.exp(min(0, w - bar)) for w in want.values()))
    assert sum(r.kept for r in got) == k and min(r.key for r in got if r.kept) > max((r.key for r in got if not r.kept), default=-1e9)


def test_threshold_is_exact(spark):
    values = np.random.default_rng(1).gumbel(size=3000).tolist() + [5.0] * 50
    keys = spark.createDataFrame([(float(v),) for v in values], "key double")
    order = sorted(values, reverse=True)
    for k in (1, 10, 60, 1500, 3049, 3050, 9999):
        assert quality.threshold(keys, k) == order[min(k, len(order)) - 1]
    assert quality.threshold(keys.where("false"), 5) is None and quality.threshold(keys, 0) is None


def test_odd_rows(spark):
    rows = [(None, None, "x", 1, 2), (1, None, "x", 1, 2), (1, "", "x", 1, 2), (2, "same", "x", 1, 2), (2, "same", "x", 1, 2), (3, "word " * 100_000, "x", 1, 2)]
    assert quality.resample(docs(spark, rows), labels(spark, [])).where("kept").count() == 6
    assert quality.resample(docs(spark, []), labels(spark, [(1, 1, 0)])).count() == 0
    assert quality.keep_good(docs(spark, rows), labels(spark, [(None, 1, 0)])).columns == ["doc_id", "text", "kept", "_good", "key"]
    assert quality.keep_good(docs(spark, rows), labels(spark, [])).count() == 6


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_held_out_quality(spark, size):
    folder = f"/root/testdata/{size}"
    d, lab = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.resample(d, lab.where("doc_id % 2 = 0")).join(lab.where("doc_id % 2 = 1"), "doc_id")
    found = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert found[1] > 0.98 and found[0] < (0.03 if size == "sf0.1" else 0.25)
