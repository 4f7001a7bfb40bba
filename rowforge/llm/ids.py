"""Taking few rows out of many without shuffling the many.

A bitmap of hashed keys, at most ``MOST_BITS`` bits whatever the number of keys, tells rows that can't be
meant from those that may be. Only the latter are shuffled, for the exact join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 27
PAGE = 32_768  # bits of one of Spark's bitmaps
KEY = "_key_of_row"


class Marks:
    """The bitmap of the non-null keys in ``keys`` (id)."""

    def __init__(self, keys: DataFrame):
        n = max(1, keys.count())
        self.bits = int(min(MOST_BITS, max(PAGE, 1 << (16 * n).bit_length())))
        place = keys.where("id IS NOT NULL").select(self.place(F.col("id")).alias("p"))
        pages = place.groupBy(F.floor(F.col("p") / PAGE).alias("page")).agg(F.bitmap_construct_agg((F.col("p") % PAGE).cast("long")).alias("bits"))
        bitmap = np.zeros(self.bits // 8, np.uint8)
        for page, data in pages.collect():  # at most MOST_BITS / PAGE rows
            bitmap[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(data, np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    def place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits))


def select(docs: DataFrame, key: Column, marks: Marks, inside: bool) -> DataFrame:
    """Rows whose key may be marked, or those whose key can't be (null keys among them), with the key as ``KEY``."""
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], key.alias(KEY), F.when(key.isNotNull(), marks.place(key)).alias("_place_of_row"))
    shared, schema = marks.shared, rows.drop("_place_of_row").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(batch.num_columns - 1)
            p = np.asarray(place.fill_null(0))
            hit = ((shared.value[p // 8] >> (p % 8).astype(np.uint8)) & 1 == 1) & np.asarray(place.is_valid())
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(hit == inside))

    return rows.mapInArrow(run, schema)


def drop_keys(docs: DataFrame, key: Column, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` (id); of the keys in ``once`` (id) one row stays. Null keys stay."""
    marks = Marks(gone if once is None else gone.unionByName(once))
    maybe, sure = select(docs, key, marks, True), select(docs, key, marks, False)
    left = maybe.join(gone.select(F.col("id").alias(KEY)).distinct(), KEY, "left_anti")
    if once is not None:
        left = left.dropDuplicates([KEY])
    return sure.unionByName(left.select(*sure.columns)).drop(KEY)
