"""System-wide summaries: days, calendar levels, hour patterns and durations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions import columns as fn
from ridelens.operators.measures import mean_duration, roll

_KINDS = ("member_type", "rideable_type")


def timed_trips(trips: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rides with a positive duration, as the keys and measure the summaries need."""
    day = F.to_date("started_at")
    seconds = F.col("duration_sec")
    return trips.where("duration_sec > 0").select(
        day.alias("date"),
        F.hour("started_at").alias("hour"),
        fn.known("member_type").alias("member_type"),
        fn.known("rideable_type").alias("rideable_type"),
        F.when(seconds < fn.DAY_SECONDS, fn.duration_bucket(seconds)).alias("bucket_start_min"),
        "duration_sec",
        *by,
    )


def hour_cube(trips: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Measures by date, hour, category and duration bucket.

    At most 24 x 25 cells per day and category pair, so its size grows with the
    calendar and not with the rides; every summary below accepts it in place of them.
    """
    return roll(timed_trips(trips, by), "date", "hour", *_KINDS, "bucket_start_min", *by)


def _source(trips_or_cube: DataFrame) -> DataFrame:
    return timed_trips(trips_or_cube) if "started_at" in trips_or_cube.columns else trips_or_cube


def system_daily(trips: DataFrame) -> DataFrame:
    """Rides and mean duration per day."""
    return roll(_source(trips), "date").select("date", F.col("n").alias("trips"), mean_duration().alias("avg_duration_sec"))


def system_daily_detailed(trips: DataFrame) -> DataFrame:
    """Rides and mean duration per day, member type and bike type."""
    return roll(_source(trips), "date", *_KINDS).select(
        "date", *_KINDS, F.col("n").alias("trips"), mean_duration().alias("avg_duration_sec")
    )


def trip_patterns(trips: DataFrame) -> DataFrame:
    """Rides by month, hour and ISO weekday for each category pair."""
    keyed = (
        _source(trips)
        .withColumn("year_month", fn.year_month(F.col("date")))
        .withColumn("weekday", fn.iso_weekday(F.col("date")))
    )
    keys = ("year_month", "hour", "weekday", *_KINDS)
    return roll(keyed, *keys).select(*keys, F.col("n").alias("trip_count"), mean_duration().alias("avg_duration_sec"))


def trip_duration_buckets(trips: DataFrame) -> DataFrame:
    """Rides under a day by month and five-minute bucket; 120 holds two hours and more."""
    keyed = (
        _source(trips).where("bucket_start_min is not null").withColumn("year_month", fn.year_month(F.col("date")))
    )
    keys = ("year_month", "bucket_start_min", *_KINDS)
    return roll(keyed, *keys).select(*keys, F.col("n").alias("trip_count"))


LEVELS = ("day", "day_of_week", "month", "year")


def time_aggregated(trips: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Rides per calendar level and value for each category pair.

    The rides are reduced to days first; the four levels are then stacked from that
    table.  System-wide, every checkout is a return, so net flow is 0.
    """
    days = roll(_source(trips), "date", *_KINDS)
    date = F.col("date")
    stacked = {
        "day": (date.cast("string"), F.unix_date(date)),
        "day_of_week": (F.date_format(date, "EEEE"), fn.iso_weekday(date)),
        "month": (F.date_format(date, "MMMM"), F.month(date)),
        "year": (F.year(date).cast("string"), F.year(date)),
    }
    entries = F.array(
        *[
            F.struct(
                F.lit(level).alias("agg_level"),
                stacked[level][0].alias("agg_value"),
                stacked[level][1].cast("int").alias("agg_sort_key"),
            )
            for level in levels
        ]
    )
    keys = ("agg_level", "agg_value", "agg_sort_key", *_KINDS)
    leveled = days.select("*", F.inline(entries))
    return roll(leveled, *keys).select(
        *keys,
        F.col("n").alias("total_checkouts"),
        F.col("n").alias("total_returns"),
        F.lit(0).alias("net_flow"),
        F.col("n").alias("total_trips"),
        mean_duration().alias("avg_duration_sec"),
    )
