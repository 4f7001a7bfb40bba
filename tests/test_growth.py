"""What must not grow with the size of a line, a table's number of row groups, or the pairs of a group."""

import datetime
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from rowforge.llm import neardup
from rowforge.llm import text as T
from rowforge.plans.formats import dealt
from rowforge.plans.intake import RULES
from rowforge.sources import lines as P
from rowforge.streaming import chain
from rowforge.streaming.state import Correlation


def test_fixed_width_shuffles_cells_not_lines(spark):
    rows = [("a", 1, "head"), ("a", 2, "x 1 "), ("a", 3, "  2 "), ("b", 1, "head"), ("b", 2, "y|2 "), ("b", 3, "z 3 ")]
    found = P.parse_fixed_width(spark.createDataFrame(rows, "file string, line_no int, line string"), [P.Slot(1, 2), P.Slot(3, 2)])
    told = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    moved = re.findall(r"Exchange\nInput \[\d+\]: (.*)", told)
    assert moved and not any(re.search(r"\bline#", m) for m in moved)
    assert [tuple(r) for r in found.select("file", "line_no", "cells").collect()] == [("a", 2, ["x", "1"])]


def test_dealt_rows_use_all_cores_and_keep_keys_together(spark):
    rows = dealt(spark.range(400, numPartitions=1).select((F.col("id") % 200).alias("id")), "id").withColumn("p", F.spark_partition_id())
    assert rows.select("p").distinct().count() >= spark.sparkContext.defaultParallelism
    assert rows.groupBy("id").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0


def test_answers_of_many_keys_at_once():
    rng, reach = random.Random(3), 10
    notices = sorted((rng.randrange(9), rng.randrange(200), i) for i in range(80))
    due = [(rng.randrange(12), rng.randrange(200), 1000 + i, "confirm") for i in range(150)]
    frames = pd.DataFrame(due, columns=Correlation.MESSAGES), pd.DataFrame(notices, columns=Correlation.NOTICES)
    got = Correlation(reach)._answers(*frames, True)
    for (key, at, ident, _), r in zip(due, got.itertuples(), strict=True):
        near = sorted((abs(t - at), t, i) for k, t, i in notices if k == key and abs(t - at) <= reach)
        want = (None, "Orphan") if not near else (near[0][2], "OutOfOrder" if near[0][1] > at else "InOrder")
        assert (r.message_id, None if pd.isna(r.notice_id) else r.notice_id, r.outcome) == (ident, *want)
    assert len(set(got["outcome"])) == 3
    assert Correlation(reach)._answers(frames[0], frames[1].iloc[:0].astype(np.int64), False)["business_key"].isna().all()


def test_best_pair_of_each_end(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(12), 2))): rng.randrange(1, 4) for _ in range(40)}
    got = neardup.best_of(spark.createDataFrame([(*p, n) for p, n in pairs.items()], "a long, b long, trees long"))
    ends = {v for p in pairs for v in p}
    want = {max((p for p in pairs if v in p), key=lambda p: (pairs[p], -p[0], -p[1])) for v in ends}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def edited_copies(n, edits):
    """Copies of one text, each with its own new words, far apart: near copies that are not alike enough, with all of the text's other shingles in common."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(100)]
    for i in range(n):
        copy, shift = list(base), rng.randrange(96 // edits - 4)
        for k in range(edits):
            copy[4 + shift + k * (96 // edits)] = f"x{i}x{k}"
        yield i, " ".join(copy)


def test_near_copies_below_the_likeness_do_not_meet_in_pairs(spark):
    docs = spark.createDataFrame(list(edited_copies(400, 3)), "doc_id long, text string")
    sets = neardup.describe(docs).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "first")
    alone = spark.createDataFrame([], "id long, component long")
    assert neardup.meeting(sets, alone).count() <= 400  # all 79,800 pairs share most of their shingles
    assert neardup.left_over(sets, alone).count() == 0


def test_pairs_that_only_the_exact_way_finds(spark):
    rows = list(edited_copies(300, 3))
    rows += [(1000 + i, text + " and more") for i, text in rows[::10]]  # two more shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = neardup.describe(docs).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "first")
    shingles = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    alike = {(i, j) for i in shingles for j in shingles if i != j and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j])}
    got = {(r.a, r.b) for r in neardup.left_over(sets, spark.createDataFrame([], "id long, component long")).collect()}
    assert len(alike) >= 60 and alike <= got | {(b, a) for a, b in got}


def test_shares_of_a_batch_are_read_not_joined_again(spark, tmp_path, monkeypatch):
    folder = tmp_path / "orders"
    folder.mkdir()
    lines = [",".join(h for h, _ in RULES), *[",".join(f"v{k}" for _ in RULES) for k in range(5)]]
    (folder / "a.csv").write_text("\n".join(lines) + "\n")
    files = spark.createDataFrame([(f"file:{folder}/a.csv", "orders", datetime.datetime(2026, 1, 1))], "path string, folder string, mtime timestamp")
    shares = []
    monkeypatch.setattr(chain, "append_once", lambda rows, *_: shares.append(rows))
    chain.import_batch(str(tmp_path / "chain"), RULES, spark.createDataFrame([("orders", 7)], "folder string, config_id long"), 2)(files, 0)
    assert [sorted(r.row_number for r in s.collect()) for s in shares] == [[1, 2, 3], [4, 5]]
    assert all("Join" not in s._jdf.queryExecution().optimizedPlan().toString() for s in shares)


def test_short_texts_beside_long_ones_are_compared_in_bounded_pieces(monkeypatch):
    long = [" ".join(f"w{k}x{j}" for j in range(3000)) for k in range(300)]
    short = [f"one two three four five {k}" for k in range(300)]
    x, y = [*short, *long[:3], "a", None], [*long, *long[:3], long[0] + long[1], None]
    sizes, words = [], T.words
    monkeypatch.setattr(T, "words", lambda column: sizes.append(len(T.utf8(column)[0])) or words(column))
    rows = pa.RecordBatch.from_arrays([pa.array(range(305)), pa.array(range(1000, 1305)), pa.array(x), pa.array(y)], names=["a", "b", "x", "y"])
    got = [r["a"] for batch in neardup.alike(iter([rows])) for r in batch.to_pylist()]
    assert got == [300, 301, 302]
    assert sum(map(len, long)) > 6e6 and max(sizes) <= 1 << 21  # each text is far below that
