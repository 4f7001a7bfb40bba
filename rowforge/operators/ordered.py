"""Ordered work inside groups that may hold a large share of all rows.

A plain window sends a whole group to one task. Here each group is cut into
ranges of its order column first; the window runs per (group, range) and only one
small row per range travels to the group to join the pieces up again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"


def id_range(c: Column, width: int = 1_000_000) -> Column:
    """Range of a unique number: never more than ``width`` rows per range."""
    return F.floor(c / F.lit(width)).cast("bigint")


def time_range(c: Column, seconds: int = 3600) -> Column:
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def latest(df: DataFrame, keys: list[str], order: list[str], oldest: bool = False) -> DataFrame:
    """One row per key, the last by ``order``. Partial aggregation leaves one row
    per key and task before the shuffle, so hot keys cost nothing extra."""
    pick = F.min_by if oldest else F.max_by
    rest = [c for c in df.columns if c not in keys]
    best = pick(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], span: Column, out: str = "row_number"
) -> DataFrame:
    """Contiguous numbers from 1 per key. ``span`` must grow with the first order column."""
    ranged = df.withColumn(RANGE, span)
    local = Window.partitionBy(*keys, RANGE).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, RANGE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        ranged.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, RANGE])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .select(*df.columns, out)
    )


def _last(name: str, n: int) -> Column:
    return F.slice(name, F.greatest(F.size(name) - n + 1, F.lit(1)), n)


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], span: Column, depth: int = 1,
    out: str = "previous",
) -> DataFrame:
    """Array of the ``cols`` of up to ``depth`` earlier rows of the key, nearest last.

    The last ``depth`` rows of every range are copied in front of the next ranges, so
    rows at the start of a range see their true predecessors."""
    ranged = df.withColumn(RANGE, span)
    item = F.struct(*cols)
    tail_order = Window.partitionBy(*keys, RANGE).orderBy(*[F.desc(c) for c in order])
    tails = (
        ranged.select(*keys, RANGE, *order, item.alias("_item"))
        .withColumn("_rn", F.row_number().over(tail_order))
        .filter(F.col("_rn") <= depth)
        .groupBy(*keys, RANGE)
        .agg(F.array_sort(F.collect_list(F.struct(*order, "_item"))).alias("_tail"))
    )
    across = Window.partitionBy(*keys).orderBy(RANGE)
    carried = [F.coalesce(F.lag("_tail", i).over(across), F.array()) for i in range(depth, 0, -1)]
    heads = tails.select(*keys, RANGE, F.concat(*carried).alias("_all")).select(
        *keys, RANGE, F.transform(_last("_all", depth), lambda x: x["_item"]).alias("_head")
    )
    local = Window.partitionBy(*keys, RANGE).orderBy(*order)
    return (
        ranged.withColumn("_near", F.collect_list(item).over(local.rowsBetween(-depth, -1)))
        .join(heads, [*keys, RANGE])
        .withColumn("_seen", F.concat("_head", "_near"))
        .withColumn(out, _last("_seen", depth))
        .select(*df.columns, out)
    )


def with_next(df: DataFrame, keys: list[str], at: str, value: str, seconds: int = 86400, out: str = "next") -> DataFrame:
    """``value`` of the following row of the key in time order, null for the last."""
    back = -F.unix_micros(F.col(at).cast("timestamp"))
    seen = with_previous(
        df.withColumn("_back", back), keys, ["_back"], [value],
        F.floor(F.col("_back") / F.lit(seconds * 1_000_000)).cast("bigint"),
    )
    return seen.withColumn(out, F.try_element_at("previous", F.lit(1))[value]).drop("_back", "previous")


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, cols: list[str],
    seconds: int = 86400,
) -> DataFrame:
    """Each left row with ``cols`` of the last right row at or before its time (null when none).

    Both sides meet in (key, time range) windows; one carried value per range brings in
    the state left by earlier ranges, so neither side is broadcast or held per key."""
    payload = F.struct(*cols)
    events = (
        left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
        .withColumn("_value", F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType))
        .unionByName(
            right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), payload.alias("_value")),
            allowMissingColumns=True,
        )
        .withColumn(RANGE, time_range(F.col("_at"), seconds))
    )
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        events.groupBy(*keys, RANGE)
        .agg(F.max_by("_value", F.when(F.col("_side") == 0, F.col("_at"))).alias("_end"))
        .select(*keys, RANGE, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    )
    so_far = Window.partitionBy(*keys, RANGE).orderBy("_at", "_side")
    return (
        events.withColumn("_seen", F.last("_value", ignorenulls=True).over(so_far))
        .filter(F.col("_side") == 1)
        .join(carried, [*keys, RANGE])
        .withColumn("_hit", F.coalesce("_seen", "_carried"))
        .select("_row.*", *[F.col("_hit")[c].alias(c) for c in cols])
    )


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], span: Column) -> DataFrame:
    """Nearest-rank percentiles per key, exact, without holding a key's values in one task.

    Equal values are counted first, then counted up per (key, value range)."""
    freq = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn(RANGE, span)
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    ranges = (
        freq.groupBy(*keys, RANGE)
        .agg(F.sum("_n").alias("_rows"))
        .select(
            *keys, RANGE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
            F.sum("_rows").over(whole).alias("_total"),
        )
    )
    up_to = Window.partitionBy(*keys, RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        freq.withColumn("_up", F.sum("_n").over(up_to))
        .join(ranges, [*keys, RANGE])
        .withColumn("_high", F.col("_up") + F.col("_offset"))
    )
    hits = [
        F.max(
            F.when(
                (F.ceil(F.col("_total") * share) <= F.col("_high"))
                & (F.ceil(F.col("_total") * share) > F.col("_high") - F.col("_n")),
                F.col(value),
            )
        ).alias(name)
        for name, share in shares.items()
    ]
    return ranked.groupBy(*keys).agg(*hits)
