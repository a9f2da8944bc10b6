"""Filters a user can set on the summary tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.schemas import USUAL_MEMBERS, USUAL_RIDEABLES


def date_range(picked) -> tuple:
    """(start, end) of a picked range; a single date means that day."""
    if isinstance(picked, (tuple, list)):
        return (picked[0], picked[-1])
    return (picked, picked)


def between_dates(df: DataFrame, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Rows dated from ``start`` to ``end``, both included; None leaves a side open."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def between_months(df: DataFrame, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Rows of the months from that of ``start`` to that of ``end``."""
    if start is not None:
        df = df.where(F.col("year_month") >= str(start)[:7])
    if end is not None:
        df = df.where(F.col("year_month") <= str(end)[:7])
    return df


def of_kinds(
    df: DataFrame, members: tuple[str, ...] = USUAL_MEMBERS, rideables: tuple[str, ...] = USUAL_RIDEABLES
) -> DataFrame:
    """Rows of the chosen categories; an untouched choice filters nothing.

    The usual choices leave "unknown" out, yet keep it while nobody narrows them.
    """
    if set(members) != set(USUAL_MEMBERS):
        df = df.where(F.col("member_type").isin(*members))
    if set(rideables) != set(USUAL_RIDEABLES):
        df = df.where(F.col("rideable_type").isin(*rideables))
    return df


def only_kinds(df: DataFrame, members: tuple[str, ...], rideables: tuple[str, ...]) -> DataFrame:
    """Rows of exactly the chosen categories."""
    return df.where(F.col("member_type").isin(*members) & F.col("rideable_type").isin(*rideables))


def options(df: DataFrame, column: str) -> DataFrame:
    """Sorted choices of a column without null, empty text and "Unknown"."""
    value = F.col(column)
    return df.select(column).where(value.isNotNull() & ~value.isin("", "Unknown")).distinct().orderBy(column)
