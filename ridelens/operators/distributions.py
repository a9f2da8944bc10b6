"""Quantiles read off counts per distinct value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _running(group: list[str], value: str):
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    return w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def nearest_quantile(df: DataFrame, group: list[str], value: Column, q: float, name: str) -> DataFrame:
    """Per group, the value at the sorted position nearest to ``q * (n - 1)``.

    Half positions round up.  Values are counted first, so a group's window holds its
    distinct values only.
    """
    counts = (
        df.select(*group, value.alias("_value"))
        .where("_value is not null")
        .groupBy(*group, "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    whole = Window.partitionBy(*group)
    position = F.floor((F.sum("_n").over(whole) - 1) * F.lit(float(q)) + 0.5)
    return (
        counts.select(
            *group, "_value", F.sum("_n").over(_running(group, "_value")).alias("_upto"), position.alias("_at")
        )
        .where("_upto > _at")
        .groupBy(*group)
        .agg(F.min("_value").alias(name))
    )


def with_running_total(buckets: DataFrame, value: str, count: str, name: str = "running") -> DataFrame:
    """Running total over a whole bucket table.

    One task orders the rows: use it on tables whose buckets are a fixed set.
    """
    return buckets.withColumn(name, F.sum(count).over(_running([], value)))
