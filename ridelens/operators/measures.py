"""Mergeable trip measures.

A measured table holds ``n`` (rides), ``n_timed`` (rides with a duration) and ``secs``
(their total) per key.  Coarser keys are sums of finer ones, so several summaries can
share one scan of the rides, and every mean is one division of exact integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roll(df: DataFrame, *keys: str) -> DataFrame:
    """Measure rides by ``keys``, or merge an already measured table to them."""
    if "n" in df.columns:
        parts = [F.sum(c).alias(c) for c in ("n", "n_timed", "secs")]
    else:
        parts = [
            F.count(F.lit(1)).alias("n"),
            F.count("duration_sec").alias("n_timed"),
            F.sum("duration_sec").alias("secs"),
        ]
    return df.groupBy(*keys).agg(*parts)


def mean_duration() -> Column:
    """Mean duration of a measured row, ignoring rides without one."""
    return F.try_divide("secs", "n_timed")


def mean_of(value: str, weight: str | None = None) -> Column:
    """Mean of already averaged values: unweighted, or weighted by a count column.

    The unweighted form treats a day with one ride like a day with a thousand.
    """
    if weight is None:
        return F.avg(value)
    counted = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(counted))
