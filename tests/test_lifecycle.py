"""Import, normalize, retry, reprocess and report over a 100-row file with two bad rows."""

import pytest
from pyspark.sql import functions as F

from rowforge.functions.convert import Field
from rowforge.operators import attempts as A
from rowforge.operators import config as G
from rowforge.operators import correlate as O
from rowforge.operators import intake as I
from rowforge.operators import normalize as N
from rowforge.operators import recovery as V
from rowforge.operators import transfer as X
from rowforge.sinks import tables as W

V1 = [Field("no", "order_no", "text", True), Field("day", "order_date", "date", True)]
V2 = [V1[0], Field("day", "order_date", "date", True, "dd/MM/yyyy")]


@pytest.fixture
def source(spark):
    """Rows 10 and 20 carry the other date format."""
    n = F.col("id")
    day = F.when(n.isin(10, 20), "31/01/2026").otherwise("2026-01-31")
    return spark.range(1, 101).select(
        n.alias("source_row_id"), F.lit(1).alias("file_job_id"), n.alias("row_number"), n.cast("string").alias("no"), day.alias("day")
    )


def counts(attempts):
    r = A.file_counts(attempts).first()
    return r.pending, r.done, r.invalid, r.failed


def run(results, run_id, version, kind="Reprocess"):
    return A.append_attempts(results, run_id, kind, F.lit(version))


def test_acceptance(spark, source):
    first = N.normalize(source, V1)
    assert N.valid_rows(first).count() == 98
    assert [(r.row_number, r.field, r.reason) for r in N.row_errors(first).orderBy("row_number").collect()] == [
        (10, "order_date", "InvalidDate"), (20, "order_date", "InvalidDate"),
    ]
    log = run(first, 1, 1, "Initial")
    assert counts(log) == (0, 98, 2, 0)
    jobs = spark.createDataFrame([(1, "Imported"), (2, "ImportFailed")], "file_job_id int, import_status string")
    status = {r.file_job_id: r.normalization_status for r in A.file_status(jobs, A.file_counts(log)).collect()}
    assert status == {1: "CompletedWithErrors", 2: "InProgress"}


def test_failed_import_continues_after_row_49(spark, source, tmp_path):
    path = str(tmp_path / "source")
    W.append_source(source.filter("row_number < 50"), path)
    assert spark.read.parquet(path).count() == 49
    W.append_source(source, path)
    stored = spark.read.parquet(path)
    assert (stored.count(), stored.select("row_number").distinct().count()) == (100, 100)


def test_reprocess_keeps_the_last_good_result(source):
    runs = [N.normalize(source, f).withColumns({"run_id": F.lit(i), "version": F.lit(i)}) for i, f in ((1, V1), (2, V2))]
    current = A.upsert_normalized(N.valid_rows(runs[0]), N.valid_rows(runs[1]))
    # version 2 reads only the two rows version 1 could not
    assert {(r.version, r["count"]) for r in current.groupBy("version").count().collect()} == {(1, 98), (2, 2)}
    log = run(runs[0], 1, 1, "Initial").unionByName(run(runs[1], 2, 2))
    assert counts(log) == (0, 2, 98, 0)  # counts follow the latest run, errors included
    state = {r.source_row_id: r for r in A.row_state(log).collect()}
    assert (state[1].latest_status, state[1].current_version) == ("Invalid", 1)
    assert (state[10].latest_status, state[10].current_version) == ("Done", 2)
    assert A.file_errors(runs[0].unionByName(runs[1])).count() == 98


def test_repeated_run_changes_nothing(source):
    done = N.valid_rows(N.normalize(source, V1)).withColumn("run_id", F.lit(1))
    assert A.upsert_normalized(done, done).count() == 98


def test_row_retry(source):
    results = N.normalize(source, V1)
    broken = run(results.withColumn("status", F.when(F.col("row_number") == 5, "Failed").otherwise(F.col("status"))), 1, 1, "Initial")
    assert counts(broken) == (0, 97, 2, 1)
    fixed = A.retry_rows(broken, results)
    assert counts(fixed) == (0, 98, 2, 0) and fixed.count() == 100


def test_overlap_is_refused(spark, source):
    log = run(N.normalize(source, V1), 1, 1).withColumn("status", F.when(F.col("row_number") == 3, "Pending").otherwise(F.col("status")))
    assert [r.source_row_id for r in A.overlap_conflicts(source, log).collect()] == [3]
    assert A.without_overlap(source, log).count() == 99


def test_retry_eligibility(spark):
    df = spark.createDataFrame([("Failed",), ("Done",)], "status string")
    assert {(r.status, r.accepted, r.refusal) for r in A.eligible_for_retry(df, "Failed").collect()} == {
        ("Failed", True, None), ("Done", False, "NotRetryable:Done"),
    }


def test_statuses_add_up(source):
    log = run(N.normalize(source, V1), 1, 1)
    assert sum(counts(log)) == source.count()


def test_reprocess_needs_its_columns(source):
    with pytest.raises(ValueError, match="customer"):
        A.source_for_reprocess(source, ["no", "customer"])


def test_config_compiles_to_fields(spark):
    columns = spark.createDataFrame(
        [(2, "order_no", "text", True, 1), (2, "order_date", "date", True, 2)],
        "table_id int, name string, data_type string, is_required boolean, ordinal int",
    )
    rules = '[{"sourceColumn":"no","normalizedColumn":"order_no"},{"sourceColumn":"day","normalizedColumn":"order_date","format":"dd/MM/yyyy"}]'
    versions = G.parse_rules(
        spark.createDataFrame([(5, 1, 2, "[]", rules)], "version_id int, source_table_id int, normalized_table_id int, file_to_source string, source_to_normalized string")
    )
    assert G.fields_of(versions, columns, 5) == V2
    sized = columns.withColumns({"precision": F.lit(20), "scale": F.lit(15), "max_length": F.when(F.col("name") == "order_no", 9)})
    got = G.fields_of(versions, sized, 5)
    assert [(f.precision, f.scale, f.max_length) for f in got] == [(20, 15, 9), (20, 15, None)]


def test_header_closes_only_after_all_targets(spark):
    headers = spark.createDataFrame([(1, "I"), (2, "I"), (3, "I"), (4, "E")], "trans_id int, stat_flag string")
    ops = spark.createDataFrame(
        [(1, "a", "Succeeded"), (2, "a", "Succeeded"), (2, "b", "Failed"), (3, "a", "Succeeded"), (3, "b", "Succeeded"),
         (4, "a", "Succeeded"), (4, "b", "Succeeded")], "trans_id int, target_id string, result string",
    )
    due = [(i, t, 1) for i in (1, 2, 3, 4) for t in "ab"] + [(5, "a", 1), (5, "b", 0)]
    selected = spark.createDataFrame(due, "trans_id int, target_id string, n_rows long")
    headers = headers.union(spark.createDataFrame([(5, "I"), (6, "I")], headers.schema))
    ops = ops.union(spark.createDataFrame([(5, "a", "Succeeded")], ops.schema))
    got = {r.trans_id: r.stat_flag for r in X.close_headers(headers, ops, selected).collect()}
    assert got == {1: "I", 2: "E", 3: "A", 4: "E", 5: "A", 6: "I"}


def test_rows_are_scoped_by_transaction(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "row_number int, trans_id int")
    assert [(r.row_number, r.n_trans) for r in X.collisions(rows).collect()] == [(1, 2)]


def test_resumed_operations_run_once(spark):
    ops = spark.createDataFrame([("f", "s", 1, "t", "PRIMARY", 1), ("f", "s", 2, "t", "PRIMARY", 1)],
                                "file_id string, sheet_id string, source_row_id int, target_id string, operation_type string, business_revision int")
    keyed = V.with_operation_key(ops)
    ledger = keyed.filter("source_row_id = 1").select("operation_key", F.current_timestamp().alias("committed_at"))
    assert [r.source_row_id for r in V.resume_failed(keyed.union(keyed), ledger).collect()] == [2]


def test_status_log(spark):
    log = spark.createDataFrame(
        [(1, 1, "Queued"), (1, 2, "Delaying"), (1, 3, "Importing"), (1, 4, "Imported"), (2, 1, "Queued"), (2, 2, "Imported")],
        "file int, n long, status string",
    )
    bad = O.illegal_transitions(log, "file", ["n"], "import", F.floor(F.col("n") / 2)).collect()
    assert [(r.file, r.from_status, r.status) for r in bad] == [(2, "Queued", "Imported")]


def test_admission_is_oldest_first(spark):
    waiting = spark.range(500).select("id", F.when(F.col("id") % 2 == 0, 1).alias("sent_at"))
    assert [r.id for r in I.admit(waiting, 3).collect()] == [1, 3, 5]
