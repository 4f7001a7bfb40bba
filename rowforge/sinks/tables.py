"""Table writers that can be repeated without doubling rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rowforge.operators.attempts import upsert_normalized
from rowforge.operators.intake import new_rows_only


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_source(df: DataFrame, path: str, key: tuple[str, ...] = ("file_job_id", "row_number")) -> None:
    """Append the rows whose key is not stored yet; conflicts are ignored."""
    stored = read_table(df.sparkSession, path)
    fresh = df.dropDuplicates(list(key)) if stored is None else new_rows_only(df, stored, key)
    fresh.write.mode("append").parquet(path)


def write_run(df: DataFrame, path: str, run_id: int) -> None:
    """Results of one run in the run's own folder; repeating the run replaces only that folder."""
    df.drop("run_id").write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def evolve_table(df: DataFrame, path: str) -> DataFrame:
    """Old and new files under one schema; columns added later are null in old rows."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.option("mergeSchema", "true").parquet(path)


def current_results(runs: DataFrame) -> DataFrame:
    """Current Normalized rows out of the stored results of all runs."""
    done = runs.filter(F.col("status") == "Done")
    return upsert_normalized(done, done.limit(0))
