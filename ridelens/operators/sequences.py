"""Numbering and look-back along a key's rows in time order, split into time slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_and_look_back(
    df: DataFrame, key: str, slice_by: Column, order: list[str], look_back: str, number_name: str, previous_name: str
) -> DataFrame:
    """Row number and previous ``look_back`` value per ``key`` along a total ``order``.

    ``key`` has no nulls.  ``slice_by`` is an integer that does not decrease along
    ``order`` (the day of its first column, say); null counts as first.  A window over
    a whole key would put a hot key's rows into one task.  Here rows are sorted within
    (key, slice), and a summary with one row per (key, slice) carries the count and the
    last value of the earlier slices across the boundary.  The rows are read and shuffled
    once: window, summary and join use the same partitioning, and as the summary takes
    whole rows along, it reads the very shuffle that the window reads.
    """
    sliced = df.withColumn("_slice", F.coalesce(slice_by.cast("int"), F.lit(-(2**31)).cast("int"))).repartition(key, "_slice")
    within = Window.partitionBy(key, "_slice").orderBy(*order)
    rows = sliced.withColumn("_number", F.row_number().over(within)).withColumn(
        "_previous", F.lag(look_back).over(within)
    )

    # The row is wrapped because values may be null; the order columns decide the maximum.
    last = F.max(F.struct(*order, F.struct(*df.columns).alias("_last")))["_last"]
    earlier = Window.partitionBy(key).orderBy("_slice")
    offset = F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    summary = (
        sliced.groupBy(key, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"), last.alias("_last"))
        .select(
            key,
            "_slice",
            F.coalesce(offset, F.lit(0)).alias("_offset"),
            F.lag("_last").over(earlier)[look_back].alias("_carried"),
        )
    )
    return rows.join(summary, [key, "_slice"], "left").select(
        *df.columns,
        (F.col("_number") + F.col("_offset")).cast("bigint").alias(number_name),
        F.when(F.col("_number") == 1, F.col("_carried")).otherwise(F.col("_previous")).alias(previous_name),
    )
