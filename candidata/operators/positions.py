"""Running totals and positions within groups of any size.

A window over a group puts the whole group into one task. Here rows are dealt by ranges of
group and order first; Spark finds the borders in a sample of the data, so a busy group, day or
score is cut into as many parts as its rows need, whatever its ids or times look like. The parts
are stored, part totals are aggregated, and their running sums are taken over the small table of
totals (a row per part, and one more per group that begins in it). The stored parts are what every
later task reads, so a lost task is repeated with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candidata.cluster import written

GROUP = "_group"
ROW_BITS = 33


def _offsets(totals: DataFrame, keys: Sequence[str], size: str, total: str | None) -> DataFrame:
    """Add to the rows of `totals` what their group holds in earlier parts, and in all."""
    group_keys = [F.col(f"{GROUP}.{k}") for k in keys]
    before = (
        Window.partitionBy(*group_keys)
        .orderBy(f"{GROUP}._part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    added = {"_before": F.coalesce(F.sum(size).over(before), F.lit(0))}
    if total:
        added[total] = F.sum(size).over(Window.partitionBy(*group_keys))
    return totals.withColumns(added)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str, *, total: str | None = None
) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the group up to this one.

    total: also add the sum over the whole group. Rows that are equal in keys and order share a
    part, so sum them up before where there may be many. The input is read twice, once for the
    sample of the borders, and its rows are shuffled twice: keep them narrow.
    """
    parts = df.withColumn("_value", value).repartitionByRange(*[F.col(k) for k in keys], *order)
    parts = written(parts.withColumn("_part", F.spark_partition_id()), "parts")
    # Keys are compared inside a struct, where null equals null.
    rows = parts.withColumn(GROUP, F.struct(*keys, "_part")).drop("_part")
    totals = rows.groupBy(GROUP).agg(F.sum("_value").alias("_sum"))
    offsets = _offsets(totals, keys, "_sum", total).drop("_sum")
    frame = Window.partitionBy(GROUP).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(offsets, GROUP)
        .withColumn(out, F.col("_before") + F.sum("_value").over(frame))
        .drop(GROUP, "_before", "_value")
    )


def position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, *, total: str | None = None) -> DataFrame:
    """Add `out`: 1 for the first row of the group, 2 for the next, and so on.

    total: also add the number of rows of the group. `order` should tell rows apart; equal ones
    share a part. The parts are stored in order, each row with its place in its part, so a
    position is the place, less that of the group's first row, plus the rows of earlier parts.
    Rows are shuffled once; they are read in place where the table of part totals is small.
    """
    by = [*[F.col(k) for k in keys], *order]
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # The upper bits are the part, the lower ones the place in it.
    parts = written(parts.withColumn("_place", F.monotonically_increasing_id()), "parts")
    part, place = F.shiftright("_place", ROW_BITS), F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)
    rows = parts.withColumn(GROUP, F.struct(*keys, part.alias("_part")))
    totals = rows.groupBy(GROUP).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_size"))
    # Stored first, so that its size is known when the join is planned.
    offsets = written(_offsets(totals, keys, "_size", total).drop("_size"), "offsets")
    number = place - F.col("_first") + F.col("_before") + 1
    return rows.join(offsets, GROUP).withColumn(out, number).drop(GROUP, "_place", "_first", "_before")
