"""Queries behind the system pages: totals, patterns, durations and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions import columns as fn
from ridelens.operators.distributions import with_running_total
from ridelens.operators.measures import mean_of
from ridelens.operators.ranking import at_maximum, top
from ridelens.plans.filters import between_dates, only_kinds
from ridelens.schemas import USUAL_MEMBERS, USUAL_RIDEABLES


def coverage(daily: DataFrame) -> DataFrame:
    """First and last date and number of rows of a daily table."""
    return daily.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count(F.lit(1)).alias("rows"))


def system_kpis(daily: DataFrame, start=None, end=None, weighted: bool = False) -> DataFrame:
    """Trips, mean duration in minutes, days and trips per day over a date range."""
    mean = mean_of("avg_duration_sec", "_n" if weighted else None)
    totals = (
        between_dates(daily, start, end)
        .withColumn("_n", F.col("trips"))
        .agg(
            F.coalesce(F.sum("trips"), F.lit(0)).alias("total_trips"),
            fn.minutes(mean).alias("avg_duration_min"),
            F.count(F.lit(1)).alias("num_days"),
        )
    )
    per_day = F.coalesce(F.try_divide("total_trips", "num_days"), F.lit(0.0))
    return totals.withColumn("avg_daily_trips", per_day)


# --- hour and weekday patterns -------------------------------------------------------
def trips_by_hour(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("hour").agg(F.sum("trip_count").alias("trip_count"))


def peak_hours(patterns: DataFrame, k: int = 3) -> DataFrame:
    return top(trips_by_hour(patterns), [F.desc("trip_count"), F.asc("hour")], k)


def trips_by_weekday(patterns: DataFrame) -> DataFrame:
    return (
        patterns.groupBy("weekday")
        .agg(F.sum("trip_count").alias("trip_count"))
        .withColumn("weekday_label", fn.weekday_label(F.col("weekday")))
    )


# --- durations from bucket counts ----------------------------------------------------
def _bucket_totals(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("bucket_start_min").agg(F.sum("trip_count").alias("trip_count"))


def duration_histogram(buckets: DataFrame) -> DataFrame:
    """Rides per bucket with its label and the running total (25 buckets at most)."""
    return with_running_total(_bucket_totals(buckets), "bucket_start_min", "trip_count").select(
        "bucket_start_min", fn.bucket_label(F.col("bucket_start_min")).alias("label"), "trip_count", "running"
    )


def duration_stats(buckets: DataFrame) -> DataFrame:
    """Mean and median from bucket midpoints, 99th percentile from a bucket's end."""
    histogram = duration_histogram(buckets)
    total = _bucket_totals(buckets).agg(F.sum("trip_count")).scalar()
    start, count = F.col("bucket_start_min"), F.col("trip_count")
    half = fn.BUCKET_MINUTES / 2

    def first_from(q: float):
        return F.min(F.when(F.col("running") >= total * F.lit(q), start))

    return histogram.agg(
        F.sum("trip_count").alias("total_trips"),
        F.try_divide(F.sum((start + half) * count), F.sum("trip_count")).alias("mean_min"),
        (first_from(0.5) + half).alias("median_min"),
        (F.coalesce(first_from(0.99), F.max(start)) + float(fn.BUCKET_MINUTES)).alias("p99_min"),
    )


# Range labels and the minute each begins at.
DURATION_RANGES = {
    "Quick (0–10 min)": 0,
    "Short (10–20 min)": 10,
    "Medium (20–30 min)": 20,
    "Long (30–60 min)": 30,
    "Very Long (60+ min)": 60,
}


def duration_ranges(buckets: DataFrame) -> DataFrame:
    """Rides and share per duration range; ranges without rides are listed with 0."""
    starts = [*DURATION_RANGES.values(), None]
    bucket = F.col("bucket_start_min")
    sums = [F.sum("trip_count").alias("total")]
    entries = []
    for i, label in enumerate(DURATION_RANGES):
        inside = bucket >= starts[i]
        if starts[i + 1] is not None:
            inside = inside & (bucket < starts[i + 1])
        sums.append(F.coalesce(F.sum(F.when(inside, F.col("trip_count"))), F.lit(0)).alias(f"range_{i}"))
        entries.append(F.struct(F.lit(label).alias("range"), F.col(f"range_{i}").alias("trip_count")))
    return (
        buckets.agg(*sums)
        .select("total", F.inline(F.array(*entries)))
        .select("range", "trip_count", fn.share(F.col("trip_count"), F.col("total")).alias("pct"))
    )


# --- daily totals and records --------------------------------------------------------
def daily_trend(detailed: DataFrame) -> DataFrame:
    return detailed.groupBy("date").agg(F.sum("trips").alias("trips"))


def busiest_quietest(detailed: DataFrame) -> DataFrame:
    """The days with most and fewest rides; the earlier day wins a tie."""
    early = -F.unix_date("date")
    order_high, order_low = F.struct(F.col("trips"), early), F.struct(F.col("trips"), F.unix_date("date"))
    return daily_trend(detailed).agg(
        F.max_by("date", order_high).alias("busiest_date"),
        F.max("trips").alias("busiest_trips"),
        F.min_by("date", order_low).alias("quietest_date"),
        F.min("trips").alias("quietest_trips"),
    )


def by_member(detailed: DataFrame) -> DataFrame:
    return detailed.groupBy("member_type").agg(F.sum("trips").alias("count")).orderBy(F.desc("count"), "member_type")


def by_rideable(detailed: DataFrame) -> DataFrame:
    """Rides per bike type, the unknown type left out."""
    return (
        detailed.where("rideable_type != 'unknown'")
        .groupBy("rideable_type")
        .agg(F.sum("trips").alias("count"))
        .orderBy(F.desc("count"), "rideable_type")
    )


def annual_totals(detailed: DataFrame) -> DataFrame:
    return detailed.groupBy(F.year("date").alias("year")).agg(F.sum("trips").alias("trips"))


# --- calendar levels -----------------------------------------------------------------
def time_summary(
    levels: DataFrame,
    level: str = "day",
    members: tuple[str, ...] = USUAL_MEMBERS,
    rideables: tuple[str, ...] = USUAL_RIDEABLES,
    weighted: bool = False,
) -> DataFrame:
    """One calendar level summed over the chosen categories."""
    mean = mean_of("avg_duration_sec", "total_trips" if weighted else None)
    return (
        only_kinds(levels.where(F.col("agg_level") == level), members, rideables)
        .groupBy("agg_value", "agg_sort_key")
        .agg(
            F.sum("total_checkouts").alias("checkouts"),
            F.sum("total_returns").alias("returns"),
            F.sum("net_flow").alias("net_flow"),
            mean.alias("avg_duration_sec"),
            F.sum("total_trips").alias("_trips"),
        )
        .withColumnRenamed("_trips", "total_trips")
        .withColumn("avg_duration_min", fn.minutes(F.col("avg_duration_sec")))
    )


def time_kpis(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.sum("checkouts").alias("total_checkouts"),
        F.sum("returns").alias("total_returns"),
        F.sum("net_flow").alias("net_flow"),
        F.avg("avg_duration_min").alias("avg_duration_min"),
    )


def time_table(summary: DataFrame) -> DataFrame:
    """The summary as displayed and exported."""
    return summary.orderBy("agg_sort_key").select(
        "agg_value",
        "checkouts",
        "returns",
        "net_flow",
        "total_trips",
        F.round("avg_duration_min", 1).alias("avg_duration_min"),
    )


def time_insights(summary: DataFrame) -> DataFrame:
    """Values with most checkouts and most returns, ties kept, beside the overall figures."""
    kinds = ("checkouts", "returns")
    overall = summary.agg(
        F.struct(
            F.avg("avg_duration_min").alias("avg_duration_min"),
            F.sum("total_trips").alias("total_trips"),
            *[F.max(kind).alias(kind) for kind in kinds],
        )
    ).scalar()
    entries = [F.when(F.col(kind) == overall[kind], F.struct(F.lit(kind).alias("kind"), "agg_value", F.col(kind).alias("trips"))) for kind in kinds]
    highest = summary.select(F.explode(F.array_compact(F.array(*entries))).alias("entry"))
    return highest.select("entry.*", overall["avg_duration_min"].alias("avg_duration_min"), overall["total_trips"].alias("total_trips"))
