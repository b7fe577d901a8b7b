"""Numbering and carrying forward in order, where one key may hold a large part of all rows.

A window over the key alone would be one task's work for a hot key. Here the rows are sorted by ranges of (key, order),
which part a hot key over as many ranges as it fills; a window runs within a key's part of a range, and what passes
from range to range is one small row for each (key, range). The ranges are written once, because their bounds come
from a sample and must not change between the two readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialise


def in_ranges(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` written in ranges of (keys, order), with ``_range``, their number in that order."""
    n = ranges or df.sparkSession.sparkContext.defaultParallelism
    return materialise(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))


def _joined(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    # null keys meet null keys
    on = None
    right = small.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, "_range")], *[c for c in small.columns if c not in (*keys, "_range")])
    for k in (*keys, "_range"):
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = c if on is None else on & c
    return df.join(right, on, "left").drop(*[f"_k_{k}" for k in (*keys, "_range")])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the key up to each. ``order`` must tell rows of a key apart."""
    r = in_ranges(df.withColumn("_x_v", value), keys, order, ranges)
    within = r.withColumn("_x_in", F.sum("_x_v").over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = r.groupBy(*keys, "_range").agg(F.sum("_x_v").alias("_x_s"))
    before = sums.withColumn("_x_b", F.coalesce(F.sum("_x_s").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_x_s")
    return _joined(within, before, keys).withColumn(out, F.col("_x_in") + F.col("_x_b")).drop("_x_v", "_x_in", "_x_b", "_range")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "n", ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``: the place of each row among those of its key, from 1."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, ranges)


def carried_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``: the last value that is not null, of the row itself or of those before it within its key."""
    r = in_ranges(df.withColumn("_x_v", value), keys, order, ranges)
    within = r.withColumn("_x_in", F.last("_x_v", ignorenulls=True).over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    last = r.groupBy(*keys, "_range").agg(F.max_by("_x_v", F.when(F.col("_x_v").isNotNull(), F.struct(*order))).alias("_x_l"))
    earlier = last.withColumn("_x_e", F.last("_x_l", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_x_l")
    return _joined(within, earlier, keys).withColumn(out, F.coalesce("_x_in", "_x_e")).drop("_x_v", "_x_in", "_x_e", "_range")
