"""Rows that take effect once, however often they are delivered, without reading the history.

Data lie in partitions the caller names, such as config and day, which a repeated row falls into again. Each
partition has a Bloom filter of its keys: pages of bits, replaced by every batch that touches the partition. A
batch reads the filters of its own partitions; only rows the filters may have seen are compared with stored
keys, and only with those of the same partitions. What a batch costs depends on its rows and the partitions
they touch, not on the batches before it.

    data/<partition>/batch_id=<n>      rows of a batch
    filters/<partition>/version=<n>    the filter as batch n left it

A batch that runs again sees filters and rows of other batches only and replaces its own folders, so a fault at
any point between its writes is repaired by the replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.session import stage

PAGE = 32_768  # bits of one of Spark's bitmaps
PAGES = 64
KEPT_VERSIONS = 2


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none where it does not exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(where) if f.isDirectory()) if files.exists(where) else []


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _place(parts: tuple[str, ...], row) -> str:
    """Folder of a partition, as a partitioned write names it; values are plain words, numbers and dates."""
    return "/".join(f"{p}={'__HIVE_DEFAULT_PARTITION__' if row[p] is None else row[p]}" for p in parts)


def _bits(key: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Page and two bits of a key."""
    seeded = lambda n: F.xxhash64(F.lit(n), *key)
    return F.pmod(seeded(1), F.lit(PAGES)), F.pmod(seeded(2), F.lit(PAGE)), F.pmod(seeded(3), F.lit(PAGE))


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1


def _versions(spark: SparkSession, path: str, place: str, batch_id: int) -> list[int]:
    """Filters of a partition written by earlier batches, newest first."""
    found = [int(n.split("=")[1]) for n in _folders(spark, f"{path}/filters/{place}") if n.startswith("version=")]
    return sorted((v for v in found if v < batch_id), reverse=True)


def stored_rows(spark: SparkSession, path: str, places: list[str], schema, batch_id: int | None = None) -> DataFrame | None:
    """Rows of some partitions without those of ``batch_id``; None where nothing is stored."""
    there = [f"{path}/data/{p}" for p in places if _folders(spark, f"{path}/data/{p}")]
    if not there:
        return None
    rows = spark.read.option("basePath", f"{path}/data").schema(schema).parquet(*there)
    return rows if batch_id is None else rows.where(F.col("batch_id") != batch_id)


def append_once(rows: DataFrame, path: str, batch_id: int, key: tuple[str, ...], parts: tuple[str, ...]) -> dict[str, int]:
    """Write the rows whose key no other batch wrote, and tell what it took: rows written, rows compared with stored keys, partitions touched.

    The filter is written last: a batch that finds its own is complete and changes nothing, so readers
    of the data never miss a file. A row's partition must follow from the row itself, so that its repeats come to the same one. The
    partitions a batch touches are listed on the driver; a batch of one day touches one per config."""
    spark = rows.sparkSession
    page, one, two = _bits(key)
    placed = rows.dropDuplicates([*parts, *key]).withColumns({"_page": page, "_one": one, "_two": two})
    places = [_place(parts, r) for r in rows.select(*parts).distinct().collect()]
    if places and all(batch_id in _versions(spark, path, p, batch_id + 1) for p in places):
        return {"written": 0, "compared": 0, "partitions": len(places)}  # a replay of a batch whose writes are all there
    newest = {p: v[0] for p in places if (v := _versions(spark, path, p, batch_id))}
    filters = None
    if newest:
        kinds = rows.select(*parts).schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
        read = spark.read.option("basePath", f"{path}/filters").schema(f"_page long, bits binary, {kinds}, version long")
        filters = read.parquet(*[f"{path}/filters/{p}/version={v}" for p, v in newest.items()]).drop("version")
        seen = placed.join(filters, [*parts, "_page"], "left")
        judged = stage(seen.withColumn("_maybe", F.coalesce(_is_set(F.col("bits"), F.col("_one")) & _is_set(F.col("bits"), F.col("_two")), F.lit(False))).drop("bits"), "judged")
        maybe, fresh = judged.where("_maybe").drop("_maybe"), judged.where(~F.col("_maybe")).drop("_maybe")
        compared = maybe.count()
        if compared:
            touched = [_place(parts, r) for r in maybe.select(*parts).distinct().collect()]
            old = stored_rows(spark, path, touched, T.StructType([*rows.schema, T.StructField("batch_id", T.LongType())]), batch_id)
            fresh = fresh.unionByName(maybe if old is None else maybe.join(old.select(*parts, *key), [*parts, *key], "left_anti"))
    else:
        fresh, compared = placed, 0
    fresh = stage(fresh, "fresh")
    out = fresh.drop("_page", "_one", "_two").withColumn("batch_id", F.lit(batch_id).cast("long"))
    out = out.hint("rebalance", *parts)  # few files a partition, and a large partition by many tasks
    out.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*parts, "batch_id").parquet(f"{path}/data")
    marks = fresh.select(*parts, "_page", F.explode(F.array("_one", "_two")).alias("at")).groupBy(*parts, "_page").agg(F.bitmap_construct_agg(F.col("at")).alias("bits"))
    if filters is not None:
        marks = marks.unionByName(filters.select(*marks.columns)).groupBy(*parts, "_page").agg(F.bitmap_or_agg("bits").alias("bits"))
    (
        marks.withColumn("version", F.lit(batch_id).cast("long")).hint("rebalance", *parts).write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
        .partitionBy(*parts, "version").parquet(f"{path}/filters")
    )
    for p in places:
        for v in _versions(spark, path, p, batch_id)[KEPT_VERSIONS - 1 :]:
            _remove(spark, f"{path}/filters/{p}/version={v}")
    return {"written": fresh.count(), "compared": compared, "partitions": len(places)}


def read_once(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows that took effect."""
    return spark.read.schema(schema).parquet(f"{path}/data").drop("batch_id")
