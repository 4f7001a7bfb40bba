"""Connected components of links between ids, with small and large stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowforge.llm.store import drop, stage
from rowforge.operators.skew import attach


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each id on its smallest one: those above it (large star) or below it (small star).

    Minima are taken before the join, and a hub's links are spread over tasks."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
    hung = attach(both, least, ["a"])
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component for every id of ``links`` (a, b): the smallest id reachable. Each round is written before the next."""
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        # Done when every id hangs on one smaller id that hangs on none.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        wide = stage(_stars(now, True), "links")
        drop(now)
        now = stage(_stars(wide, False), "links")
        drop(wide)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
