"""One named file: order, header, replacement, and going on after a fault at any step."""

import os

import pytest
from pyspark.sql import functions as F

from rowforge.operators import archive as R
from rowforge.operators import attempts as A
from rowforge.operators import config as G
from rowforge.operators import export as E
from rowforge.operators import recovery as V
from rowforge.plans import registered
from rowforge.sinks import publish as P


def test_one_file_in_order(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.range(100, numPartitions=7).select("id", F.concat(F.lit('a,"'), F.col("id").cast("string")).alias("a name"))
    path = P.publish(df, folder, "out.csv", 1)
    lines = open(path).read().splitlines()
    assert lines[0] == "id,a name" and lines[1:] == [f'{k},"a,""{k}"' for k in range(100)]
    P.publish(df.limit(0), folder, "out.csv", 2)
    assert open(path).read() == "id,a name\n"
    P.publish(df, folder, "out.csv", 1)  # a run that is done changes nothing
    assert open(path).read() == "id,a name\n"


@pytest.mark.parametrize("step", ["write", "join", "touch", "replace", "remove"])
def test_fault_at_any_step(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path)
    path = P.publish(spark.range(3), folder, "out.csv", "old")
    real = getattr(P.Files, step)
    calls = []

    def once(self, *args):
        calls.append(args)
        if step in ("replace", "touch") and len(calls) == 1:
            real(self, *args)  # done, but the run breaks behind it
        if len(calls) == 1:
            raise RuntimeError("broken")
        return real(self, *args)

    monkeypatch.setattr(P.Files, step, once)
    with pytest.raises(RuntimeError, match="broken"):
        P.publish(spark.range(5), folder, "out.csv", "new")
    assert len(open(path).read().split()) in (4, 6)  # the older file, whole, or the new one, whole
    P.publish(spark.range(5), folder, "out.csv", "new")
    assert open(path).read().split() == ["id", "0", "1", "2", "3", "4"]
    assert sorted(n for n in os.listdir(folder) if not n.startswith((".", "_"))) == ["out.csv"]


def test_recount_reads_only_changed_rows(spark):
    runs = spark.createDataFrame([(1, k, k % 3, "Failed" if k % 4 == 0 else "Done") for k in range(24)], "run_id long, source_row_id long, file_job_id long, status string")
    source = spark.range(24).select(F.col("id").alias("source_row_id"))
    seen = spark.sparkContext.accumulator(0)

    def convert(rows):
        seen.add(rows.count())
        return rows.withColumn("status", F.when(F.col("source_row_id") % 8 == 0, "Invalid").otherwise("Done"))

    changed = A.retry_failed(runs, source, convert)
    after = runs.join(changed.select("source_row_id", "after"), "source_row_id", "left").withColumn("status", F.coalesce("after", "status"))
    full = {r.file_job_id: tuple(r) for r in A.file_counts(after).collect()}
    assert {r.file_job_id: tuple(r) for r in A.recount(A.file_counts(runs), changed).collect()} == full
    assert seen.value == 6


def test_operations_meet_on_key_columns_with_missing_parts(spark):
    schema = "file_id long, sheet_id string, source_row_id long, target_id long, operation_type string, business_revision long"
    ops = spark.createDataFrame([(1, None, 1, 1, "P", 1), (1, "s", 1, 1, "P", 1), (2, None, 1, 1, "P", 1)], schema).withColumn("expected_rows", F.lit(1))
    ledger = spark.createDataFrame([(1, None, 1, 1, "P", 1), (3, "s", 1, 1, "P", 1)], schema).withColumns({"committed_at": F.current_timestamp(), "affected_rows": F.lit(1)})
    left = V.resume_failed(ops, ledger)
    assert sorted((r.file_id, r.sheet_id) for r in left.collect()) == [(1, "s"), (2, None)]
    assert sorted(r.crash_point for r in V.classify_recovery(ops, ledger).collect()) == ["Committed", "NotStarted", "NotStarted", "Unknown"]
    plan = left._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "sha2" not in plan


def test_rows_without_a_key_go_around_the_join(spark):
    rows = spark.createDataFrame([(1, "c1", "a1"), (2, None, "a1"), (3, "c1", None), (4, "c9", "a1")], "id long, chassis string, agent string")
    policy = spark.createDataFrame([("p1", "c1", "a1"), ("p0", None, "a1")], "policy_no string, chassis string, agent string").withColumn("cc_date", F.to_date(F.lit("2026-03-01")))
    motor = spark.createDataFrame([("p1", "blue")], "policy_no string, colour string")
    out = E.enrich_policy(rows, policy, motor, F.to_date(F.lit("2026-06-01")))
    assert {r.id: (r.policy_no, r.colour) for r in out.collect()} == {1: ("p1", "blue"), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_merge_of_column_definitions(spark):
    schema = "table_id long, name string, data_type string"
    stored = spark.createDataFrame([(1, "a", "text"), (1, "b", "date"), (1, "c", "text")], schema)
    defined = spark.createDataFrame([(1, "a", "text"), (1, "b", "text"), (1, "d", "boolean"), (1, "e", "blob"), (2, "a", "date")], schema)
    got = {(r.table_id, r.name): (r.data_type, r.action, r.reason) for r in G.merge_columns(stored, defined).collect()}
    assert got == {
        (1, "a"): ("text", "Kept", None), (1, "b"): ("date", "Refused", "TypeChange:date>text"), (1, "c"): ("text", "Missing", None),
        (1, "d"): ("boolean", "Added", None), (1, "e"): (None, "Refused", "UnsupportedType:blob"), (2, "a"): ("date", "Added", None),
    }


def test_moves_can_be_repeated(spark, tmp_path):
    at = lambda name: f"file:{tmp_path}/{name}"
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "c").write_text("other")
    plan = spark.createDataFrame([(at(n), at(f"old/{n}")) for n in ("a", "b", "c", "gone")], "path string, archive_path string")
    want = {"a": ("Archived", None), "b": ("Archived", None), "c": ("ArchiveFailed", "TargetExists"), "gone": ("ArchiveFailed", "SourceMissing")}
    R.move_files(plan.where("path LIKE '%/a'"))
    for _ in range(2):
        assert {os.path.basename(r.path): (r.archive_status, r.reason) for r in R.move_files(plan).collect()} == want
    assert (tmp_path / "old" / "a").read_text() == "a" and (tmp_path / "c").read_text() == "c" and (tmp_path / "old" / "c").read_text() == "other"
    with pytest.raises(ValueError, match="more than 2"):
        R.move_files(plan, most=2)


def test_a_plan_of_any_length_moves_in_batches(spark, tmp_path, monkeypatch):
    at = lambda name: f"file:{tmp_path}/{name}"
    names = [f"f{k}" for k in range(7)]
    for name in names:
        (tmp_path / name).write_text(name)
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "f3").write_text("other")
    rows = [(at(n), at(f"old/{n}")) for n in [*names, "gone", "f0"]]  # f0 stands twice
    plan = spark.createDataFrame(rows, "path string, archive_path string")
    real, sizes = R.move_files, []
    monkeypatch.setattr(R, "move_files", lambda batch, most: (sizes.append(batch.count()), real(batch, most))[1])
    want = {n: ("Archived", None) for n in names} | {"f3": ("ArchiveFailed", "TargetExists"), "gone": ("ArchiveFailed", "SourceMissing")}
    R.move_batches(plan.where("crc32(path) % 2 = 0"), most=3)
    sizes.clear()
    for _ in range(2):
        got = R.move_batches(plan, most=3).collect()
        assert len(got) == 8 and {os.path.basename(r.path): (r.archive_status, r.reason) for r in got} == want
    assert sizes == [3, 3, 2] * 2
    assert [(tmp_path / "old" / n).read_text() for n in names] == ["other" if n == "f3" else n for n in names]
    assert (tmp_path / "f3").read_text() == "f3" and not (tmp_path / "f0").exists()
    assert R.move_batches(plan.limit(0)).collect() == []


def test_more_files_than_a_batch_holds_are_all_archived(spark, tmp_path, monkeypatch):
    rows = [(500 * k + j, f"name {k} {j}", k % 25) for k in range(12) for j in range(2)]  # one file for each k
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("move_files", "move_batches"):
        if hasattr(R, name):
            monkeypatch.setattr(getattr(R, name), "__defaults__", (3,))
    got = {r.folder: (r.archive_status, r.place, r.reason) for r in registered()[0]["archive_moves"](spark, str(tmp_path)).collect()}
    lots = [k * 26 for k in range(12)]
    assert got == {f"lot={n}": ("Archived", "archive", None) if n % 5 else ("ChangedAfterRead", "drop", None) for n in lots}
