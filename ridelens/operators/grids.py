"""Dense hour-by-weekday grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_week(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key, weekday (1..7) and hour (0..23); absent or null cells are 0.

    ``df`` has at most one row per key, weekday and hour. A key's first row also brings
    every hour of the week without a value, so nothing is joined, and as all of this is
    by key, it is shuffled once.
    """
    slot = (24 * (F.col("weekday") - 1) + F.col("hour")).cast("int")
    own = F.array(F.struct(slot.alias("slot"), F.col(value).alias("value")))
    nothing = F.lit(None).cast(df.schema[value].dataType)
    week = F.transform(F.sequence(F.lit(0), F.lit(167)), lambda s: F.struct(s.alias("slot"), nothing.alias("value")))
    first = F.row_number().over(Window.partitionBy(key).orderBy("weekday", "hour")) == 1
    rows = df.withColumn("_first", first).select(key, F.inline(F.when(F.col("_first"), F.concat(own, week)).otherwise(own)))
    cells = rows.where("slot is not null").groupBy(key, "slot").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias(value))
    return cells.select(key, (F.floor(F.col("slot") / 24) + 1).cast("int").alias("weekday"), (F.col("slot") % 24).alias("hour"), value)
