"""Which months and files there should be."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTHLY_SINCE = 2018


def _month_number():
    return F.col("year") * 12 + F.col("month") - 1


def _months(numbers: DataFrame) -> DataFrame:
    number = F.col("_month")
    return numbers.select(
        F.floor(number / 12).cast("int").alias("year"), (F.pmod(number, F.lit(12)) + 1).cast("int").alias("month")
    )


def _number(day: date) -> int:
    return day.year * 12 + day.month - 1


def months_from(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Every month from that of ``first`` to that of ``last``."""
    return _months(spark.range(_number(first), _number(last) + 1).withColumnRenamed("id", "_month"))


def months_after_latest(loaded: DataFrame, until: date) -> DataFrame:
    """Months after the latest loaded one, up to that of ``until``."""
    latest = loaded.agg(F.max(_month_number()).alias("_latest"))
    numbers = F.when(
        F.col("_latest") < _number(until), F.sequence(F.col("_latest") + 1, F.lit(_number(until)))
    )
    return _months(latest.select(F.explode(numbers).alias("_month")))


def months_not_loaded(loaded: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Wanted months that are not loaded; by default gaps between the first and last."""
    if wanted is None:
        ends = loaded.agg(F.min(_month_number()).alias("_first"), F.max(_month_number()).alias("_last"))
        wanted = _months(ends.select(F.explode(F.sequence("_first", "_last")).alias("_month")))
    return wanted.join(loaded.select("year", "month"), ["year", "month"], "left_anti")


def expected_files(years: DataFrame) -> DataFrame:
    """Names of the files published for each year: one per year, later one per month."""
    months = F.when(F.col("year") >= MONTHLY_SINCE, F.sequence(F.lit(1), F.lit(12))).otherwise(
        F.array(F.lit(None).cast("int"))
    )
    listed = years.select("year", F.explode(months).alias("month"))
    name = F.concat(F.col("year").cast("string"), F.coalesce(F.lpad(F.col("month").cast("string"), 2, "0"), F.lit("")))
    return listed.select("year", "month", name.alias("file_stem"))


def years_from(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
