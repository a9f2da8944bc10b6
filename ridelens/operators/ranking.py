"""Ranks and top-k per group, safe when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def twice_average_rank(group: list[str], value: str) -> Column:
    """Twice the descending average rank of a row in its group, which is a whole number.

    Tied rows share the mean of the positions they cover, the first of which is the
    rank and the last the number of rows with no smaller value.
    """
    down = Window.partitionBy(*group).orderBy(F.col(value).desc())
    last_position = F.count(F.lit(1)).over(down.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.rank().over(down) + last_position


def within_average_rank(df: DataFrame, group: list[str], value: str, n: int) -> DataFrame:
    """Rows whose descending average rank in their group is at most ``n``.

    A tie across ``n`` is kept or dropped as a whole. The average rank is never less than
    the rank, so rows beyond rank ``n`` go first, which Spark does before the shuffle
    (WindowGroupLimit); rows that tie all stay, so the others' average ranks are the same.
    """
    down = Window.partitionBy(*group).orderBy(F.col(value).desc())
    first = df.withColumn("_rank", F.rank().over(down)).where(F.col("_rank") <= n)
    return first.withColumn("_twice", twice_average_rank(group, value)).where(F.col("_twice") <= 2 * n).drop("_rank", "_twice")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, position: str = "position") -> DataFrame:
    """The first ``k`` rows of each group in a total ``order``, numbered from 1.

    Spark cuts each group to ``k`` rows before the shuffle (WindowGroupLimit), so a
    hot group costs no more than a small one.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).where(F.col(position) <= k)


def top_ties_per_group(df: DataFrame, group: list[str], order: Column) -> DataFrame:
    """All rows that tie for first place in their group."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("_place", F.rank().over(w)).where("_place = 1").drop("_place")


def top(df: DataFrame, order: list[Column], k: int, position: str = "position") -> DataFrame:
    """The first ``k`` rows overall, numbered from 1; only ``k`` rows meet in one task."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn(position, F.row_number().over(Window.orderBy(*order)))


def at_maximum(df: DataFrame, value: str) -> DataFrame:
    """Rows that hold the column's maximum, ties included."""
    return df.where(F.col(value) == df.agg(F.max(value)).scalar())
