"""Starting, draining and restarting streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rowforge.session import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk with changelog checkpoints; needed by keyed state with timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything there is into a parquet table, then stop. Started again with the
    same checkpoint it goes on where it ended; the sink's log keeps repeated batches out."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    query = (
        stream.writeStream.foreachBatch(each).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a fresh table and read it as a batch."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    drain(stream, path, fresh_path(spark, f"{name}-checkpoint"), mode)
    return spark.read.schema(stream.schema).parquet(path)


def settled(query: StreamingQuery) -> bool:
    """Whether the last batch found no new data and left no row in any state."""
    last = query.lastProgress
    return last is not None and last["numInputRows"] == 0 and all(op["numRowsTotal"] == 0 for op in last["stateOperators"])


def run_until(stream: DataFrame, path: str, checkpoint: str, done: Callable[[StreamingQuery], bool] = settled, seconds: float = 300, mode: str = "append") -> None:
    """Run a stream by the clock, so that its timers fire without new data, until ``done``; then stop it.

    It has failed once its batches changed nothing for ``seconds``: no row came and as many stay in its states. How
    long a batch takes, or all of them, does not matter. Started again with the same checkpoint it goes on where it ended."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start()
    )
    try:
        batch = left = None
        since = time.monotonic()
        while not done(query):
            last = query.lastProgress
            if last is not None and last["batchId"] != batch:
                batch, before, left = last["batchId"], left, [op["numRowsTotal"] for op in last["stateOperators"]]
                if last["numInputRows"] or left != before:
                    since = time.monotonic()
                elif time.monotonic() - since > seconds:
                    raise TimeoutError(f"stream not done, and nothing changed for {seconds} s")
            if not query.isActive:
                query.awaitTermination()  # raises what ended it
                return
            time.sleep(0.1)
    finally:
        query.stop()


def drain_parts(parts: Iterable[DataFrame], stream: Callable[[str], DataFrame], path: str, name: str) -> None:
    """Write each part into a folder and drain ``stream`` over the folder after it, under one checkpoint: a batch or more a part."""
    folder = checkpoint = None
    for part in parts:
        if folder is None:
            folder, checkpoint = fresh_path(part.sparkSession, name), fresh_path(part.sparkSession, f"{name}-checkpoint")
        part.write.mode("append").parquet(folder)
        drain(stream(folder), path, checkpoint)


class Broken(RuntimeError):
    """A fault put between the writes and the commit of a batch."""


def breaking(handle: Callable[[DataFrame, int], None], batches: Iterable[int]) -> Callable[[DataFrame, int], None]:
    """``handle`` that fails behind its writes, once for each of ``batches``; the replay of the batch goes through."""
    left = set(batches)

    def broken(df: DataFrame, batch_id: int) -> None:
        handle(df, batch_id)
        if batch_id in left:
            left.discard(batch_id)
            raise Broken(f"batch {batch_id} broke behind its writes")

    return broken


def drain_with_restarts(stream: Callable[[], DataFrame], each: Callable[[DataFrame, int], None], checkpoint: str, restarts: int) -> int:
    """Drain into ``each``, started again after each fault, at most ``restarts`` times; the number of restarts."""
    for n in range(restarts + 1):
        try:
            drain_batches(stream(), each, checkpoint)
            return n
        except Exception as e:  # the fault comes back as the query's failure
            if n == restarts or Broken.__name__ not in str(e):
                raise
    return restarts


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A batch owns its folder, so a replayed batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
