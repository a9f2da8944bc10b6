"""Daily series: resampling, trend, hour-by-weekday grids and capacity pressure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions import columns as fn
from ridelens.operators.distributions import nearest_quantile
from ridelens.operators.grids import dense_week
from ridelens.operators.measures import mean_of

# Grid metrics by their display name.
GRID_METRICS = {"Checkouts": "num_checkouts", "Returns": "num_returns", "Net Flow": "net_flow"}
STEPS = {"Weekly": "week", "Monthly": "month"}


def of_station(df: DataFrame, station_id: int | None) -> DataFrame:
    """Rows of one station, or of all that have an id."""
    return df.where("station_id is not null") if station_id is None else df.where(F.col("station_id") == station_id)


def hourly_grid(hourly: DataFrame, metric: str = "Checkouts", station_id: int | None = None) -> DataFrame:
    """Mean of a metric per weekday and hour, 0 where a station has no rows.

    An unknown or absent metric falls back to checkouts.
    """
    column = GRID_METRICS.get(metric, "num_checkouts")
    if column not in hourly.columns:
        column = "num_checkouts"
    means = (
        of_station(hourly, station_id)
        .groupBy("station_id", fn.iso_weekday(F.col("date")).alias("weekday"), "hour")
        .agg(F.avg(column).alias("avg_value"))
    )
    return dense_week(means, "station_id", "avg_value")


def grid_range(grid: DataFrame) -> DataFrame:
    """Symmetric colour range of each station's grid; 1 where every cell is 0."""
    extent = F.coalesce(F.nullif(F.max(F.abs("avg_value")), F.lit(0.0)), F.lit(1.0))
    return grid.groupBy("station_id").agg(extent.alias("zmax")).select("station_id", (-F.col("zmax")).alias("zmin"), "zmax")


def _net_days(daily: DataFrame, station_id: int | None) -> DataFrame:
    return of_station(daily, station_id).select(
        "station_id", "date", (F.col("num_checkouts") - F.col("num_returns")).alias("net_flow")
    )


def pressure_threshold(daily: DataFrame, station_id: int | None = None, q: float = 0.9) -> DataFrame:
    """The size of net flow that ``q`` of a station's days stay within."""
    return nearest_quantile(_net_days(daily, station_id), ["station_id"], F.abs("net_flow"), q, "threshold")


def pressure_days(daily: DataFrame, station_id: int | None = None, q: float = 0.9) -> DataFrame:
    """Days whose net flow exceeds the station's threshold in either direction."""
    return (
        _net_days(daily, station_id)
        .join(pressure_threshold(daily, station_id, q), "station_id")
        .where(F.abs("net_flow") > F.col("threshold"))
    )


def flow_class(daily: DataFrame, station_id: int | None = None) -> DataFrame:
    """Departure point, arrival point or balanced, by mean daily net flow."""
    mean = F.avg("net_flow").alias("avg_net_flow")
    return (
        _net_days(daily, station_id)
        .groupBy("station_id")
        .agg(mean)
        .withColumn("flow_class", fn.flow_class(F.col("avg_net_flow")))
    )


def station_series(daily: DataFrame, metric: str = "num_checkouts", station_id: int | None = None) -> DataFrame:
    """One metric per station and day; durations in minutes."""
    value = F.col(metric)
    if metric == "avg_duration_sec":
        value = fn.minutes(value)
    return of_station(daily, station_id).select("station_id", "date", value.alias("value"))


def resample(daily: DataFrame, step: str = "Daily", weighted: bool = False) -> DataFrame:
    """Daily series by week (from Monday) or month, labelled by the first day."""
    if step not in STEPS:
        return daily
    first_day = F.date_trunc(STEPS[step], "date").cast("date").alias("date")
    mean = mean_of("avg_duration_sec", "_n" if weighted else None)
    return (
        daily.withColumn("_n", F.col("trips"))
        .groupBy(first_day)
        .agg(F.sum("trips").alias("trips"), mean.alias("avg_duration_sec"))
    )


def trend_line(series: DataFrame, value: str = "trips", name: str = "trend") -> DataFrame:
    """Adds the least-squares line over days since the first date.

    Rows whose value is null or NaN take no part in the fit and get no trend.
    """
    y = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    first = series.agg(F.min("date")).scalar()
    x = F.datediff("date", first).cast("double")
    points = series.select(x.alias("x"), y.alias("y")).where("y is not null")
    line = points.agg(
        F.struct(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    ).scalar()
    return series.withColumn(name, F.when(y.isNotNull(), line["slope"] * x + line["intercept"]))
