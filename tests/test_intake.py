"""CSV reading, numbering, headers, duplicates and repeatable writes on small files."""

import os

import pytest
from pyspark.sql import functions as F

from rowforge.operators import archive as R
from rowforge.operators import intake as I
from rowforge.operators import lifecycle as C
from rowforge.sinks import tables as W
from rowforge.sources import csv as S
from rowforge.sources import files as L
from rowforge.sources import lines as P

HEADER = "Order No,Amount,Note"
RULES = [("Order No", "order_no"), ("Amount", "amount"), ("Note", "note")]


@pytest.fixture
def folder(tmp_path):
    put = lambda name, text: (tmp_path / name).write_bytes(text.encode())
    put("a.csv", HEADER + '\n1,10,"a,b"\n2,20,"x\ny"\n3,30,"say ""hi"""\n\n\n\n')
    put("b.csv", "﻿Note,Order No,Amount\r\nn1,7,70\r\nn2,8,80\r\n")
    put("c.csv", "Order No,Note\n1,x\n")
    put("d.txt", HEADER + "\n1,2,3\n")
    put("~$e.csv", HEADER + "\n1,2,3\n")
    put("f.csv", "")
    return str(tmp_path)


def by_file(df):
    out = {}
    for r in df.collect():
        out.setdefault(os.path.basename(r.file), []).append((r.row_number, r.order_no, r.amount, r.note))
    return {k: sorted(v) for k, v in out.items()}


EXPECTED = {
    "a.csv": [(1, "1", "10", "a,b"), (2, "2", "20", "x\ny"), (3, "3", "30", 'say "hi"')],
    "b.csv": [(1, "7", "70", "n1"), (2, "8", "80", "n2")],
}


def test_listing(spark, folder):
    names = {r.file_name for r in L.list_candidates(spark, folder, "csv|TXT").collect()}
    assert names == {"a.csv", "b.csv", "c.csv", "d.txt"}


def test_records_and_missing_header(spark, folder):
    landed = S.land(spark, f"{folder}/[abc].csv", 3)
    heads = S.headers(landed)
    assert by_file(S.records(landed, heads, RULES)) == EXPECTED
    failed = S.missing_headers(heads, [h for h, _ in RULES]).collect()
    assert [(os.path.basename(r.file), r.last_error) for r in failed] == [("c.csv", "Missing header: Amount")]


def test_snapshot_gives_the_same_records_after_the_file_changed(spark, folder):
    snapshot = L.snapshot_files(spark, f"{folder}/[abc].csv")
    with open(f"{folder}/a.csv", "a") as f:
        f.write("4,40,late\n")
    landed = S.parse(snapshot, 3)
    assert by_file(S.records(landed, S.headers(landed), RULES)) == EXPECTED
    status = R.archive_status(L.live_hashes(spark, f"{folder}/[abc].csv"), snapshot.files.select("path", "sha256"), "path")
    assert {os.path.basename(r.path): r.archive_status for r in status.collect()} == {
        "a.csv": "ChangedAfterRead", "b.csv": "Archived", "c.csv": "Archived",
    }


def test_retry_adds_only_what_is_missing_with_the_same_numbers(spark, folder, tmp_path):
    snapshot = L.snapshot_files(spark, f"{folder}/[ab].csv")
    landed = S.parse(snapshot)
    done = S.records(landed, S.headers(landed), RULES).filter("row_number <> 2")
    rest = C.retry_import(snapshot, done, RULES)
    assert by_file(rest) == {"a.csv": [EXPECTED["a.csv"][1]], "b.csv": [EXPECTED["b.csv"][1]]}
    broken = L.Snapshot(snapshot.lines, snapshot.splits, snapshot.files.withColumn("sha256", F.when(F.col("file_name") == "a.csv", "0").otherwise(F.col("sha256"))))
    assert [os.path.basename(r.path) for r in C.changed_snapshots(broken).collect()] == ["a.csv"]
    assert set(by_file(C.retry_import(broken, done, RULES))) == {"b.csv"}


def test_numbers_hold_when_a_file_is_split(spark, tmp_path):
    for name in ("x", "y"):
        rows = "".join(f"{name}{i},{i},n\n" for i in range(1, 4001))
        (tmp_path / f"{name}.csv").write_text(HEADER + "\n" + rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        landed = S.land(spark, str(tmp_path), 3)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert landed.select("file", "_block").distinct().count() > 10
    rows = S.records(landed, S.headers(landed), RULES)
    assert rows.count() == 8000
    assert rows.filter(F.col("row_number").cast("string") != F.col("amount")).count() == 0


def test_duplicates_within_batch_and_registry(spark):
    new = spark.createDataFrame(
        [(1, "c", "h1"), (2, "c", "h1"), (3, "c", "h2"), (4, "d", "h1"), (5, "c", "h3")], "file_job_id int, config_id string, content_hash string"
    )
    registry = spark.createDataFrame(
        [(90, "c", "h2", "Imported"), (91, "c", "h3", "Duplicate")],
        "file_job_id int, config_id string, content_hash string, import_status string",
    )
    got = {r.file_job_id: (r.import_status, r.duplicate_of) for r in I.mark_duplicates(new, registry, ["config_id", "content_hash"], ["file_job_id"]).collect()}
    assert got == {1: ("Queued", None), 2: ("Duplicate", 1), 3: ("Duplicate", 90), 4: ("Queued", None), 5: ("Queued", None)}


def test_missed_files(spark):
    listing = spark.createDataFrame([("p1", "k1"), ("p2", "k2b"), ("p3", "k3b"), ("p4", "k4")], "path string, intake_key string")
    jobs = spark.createDataFrame(
        [("p1", "k1", "Imported"), ("p2", "k2", "Imported"), ("p3", "k3", "Importing")], "path string, intake_key string, import_status string"
    )
    assert {r.path for r in I.missed_files(listing, jobs).collect()} == {"p2", "p4"}


def test_append_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10).select(F.lit(1).alias("file_job_id"), F.col("id").alias("row_number"))
    W.append_source(rows.limit(4), path)
    W.append_source(rows.union(rows), path)
    assert spark.read.parquet(path).count() == 10


def test_rerun_replaces_only_its_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    one = spark.range(3).select("id", F.lit(1).alias("run_id"))
    W.write_run(one, path, 1)
    W.write_run(one.withColumn("run_id", F.lit(2)), path, 2)
    W.write_run(one.limit(1), path, 1)
    assert {(r.run_id, r["count"]) for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {(1, 1), (2, 3)}


def test_added_columns_are_null_in_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    W.evolve_table(spark.range(2), path)
    out = W.evolve_table(spark.range(2, 4).withColumn("note", F.lit("n")), path)
    assert {(r.id, r.note) for r in out.collect()} == {(0, None), (1, None), (2, "n"), (3, "n")}


def test_slice_past_the_end_leaves_nothing(spark):
    df = spark.range(1, 4).select(F.col("id").alias("row_number"))
    assert P.slice_records(df, 1, 9).count() == 0
    assert [r[0] for r in P.slice_records(df, 1, 2).orderBy("row_number").collect()] == [1, 2]
    assert P.slice_records(df, 0, 2).count() == 3
