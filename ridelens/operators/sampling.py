"""Reproducible samples of a fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SLOTS = 65_536


def fixed_size_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows, chosen by a hash of their keys and the seed.

    ``keys`` must identify a row.  The hash space is counted in equal slots to find the
    slot in which the n-th row lies.  Earlier slots are taken whole, and rows are
    ranked within their slot only, so no task sees more than its slots.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    drawn = df.withColumn("_draw", F.md5(text)).withColumn("_slot", F.conv(F.substring("_draw", 1, 4), 16, 10).cast("int"))
    slots = drawn.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    # At most _SLOTS rows: the one window without a partition stays small.
    last = (
        slots.select("_slot", F.coalesce(before, F.lit(0)).alias("_before"))
        .where(F.col("_before") < n)
        .agg(F.max(F.struct("_slot", "_before")))
        .scalar()
    )
    place = F.row_number().over(Window.partitionBy("_slot").orderBy("_draw"))
    return (
        drawn.where(F.col("_slot") <= last["_slot"])
        .withColumn("_place", place)
        .where((F.col("_slot") < last["_slot"]) | (F.col("_place") <= n - last["_before"]))
        .drop("_draw", "_slot", "_place")
    )
