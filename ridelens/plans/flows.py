"""Checkouts and returns per station, by day or hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.functions import columns as fn
from ridelens.operators.lookup import attach
from ridelens.operators.roles import by_role
from ridelens.operators.sampling import fixed_size_sample

_PLACE = {"station_name": "station_name", "lat": "lat", "lng": "lng"}


def _lone_side(*keys: str) -> Column:
    """Keeps the two sides apart where a key is null, as a full join of them would."""
    return F.when(fn.any_null(*keys), F.col("at_start")).alias("_lone_side")


def _net_flow(one_sided_null: bool) -> Column:
    both = (F.col("num_checkouts") > 0) & (F.col("num_returns") > 0)
    net = F.col("num_checkouts") - F.col("num_returns")
    return F.when(both, net) if one_sided_null else net


def bike_cube(trips: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rides by station, day, category, side and bike: all of them, those with a positive duration, and their seconds.

    Returns are dated by their start and have no bike. Both daily tables come from it.
    """
    own = {"date": F.to_date("started_at"), "member_type": fn.known("member_type"), "rideable_type": fn.known("rideable_type")}
    own |= {"positive": F.coalesce(F.col("duration_sec") > 0, F.lit(False)), "secs": F.col("duration_sec")} | {c: F.col(c) for c in by}
    seen = by_role(
        trips,
        start={"station_id": F.col("start_station_id"), **own, "bike": F.col("bike_number")},
        end={"station_id": F.col("end_station_id"), **own, "bike": F.lit(None).cast("string")},
    )
    return seen.groupBy("station_id", "date", "member_type", "rideable_type", "at_start", "bike", *by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("n_timed"), F.sum(F.when(F.col("positive"), F.col("secs"))).alias("secs")
    )


def _of_cube(cube: DataFrame, kinds: tuple[str, ...], timed_returns: bool) -> DataFrame:
    """A bike cube merged to station, day, ``kinds``, side and bike."""
    counted = F.col("n_timed") if timed_returns else F.when(F.col("at_start"), F.col("n_timed")).otherwise(F.col("n"))
    seconds = F.col("secs") if timed_returns else F.when(F.col("at_start"), F.col("secs"))
    return cube.where(counted > 0).groupBy("station_id", "date", *kinds, "at_start", "bike").agg(
        F.sum(counted).alias("n"), F.sum(seconds).alias("secs")
    )


def _station_days(trips: DataFrame, kinds: tuple[str, ...], returns_on: str, timed_returns: bool) -> DataFrame:
    """Flows per station and day, of rides or of a bike cube.

    Rides are first grouped down to (station, day, side, bike), which makes the number
    of distinct bikes a count of rows, null being one of them.  Both steps combine
    before they shuffle, and the first spreads a hot station over its bikes.
    """
    if "started_at" not in trips.columns:
        if returns_on != "started_at":
            raise ValueError("A bike cube has its returns dated by their start")
        return _both_sides(_of_cube(trips, kinds, timed_returns), ("station_id", "date", *kinds))
    if returns_on not in ("started_at", "ended_at"):
        raise ValueError(f"returns_on must be started_at or ended_at, not {returns_on}")
    if timed_returns:
        trips = trips.where("duration_sec > 0")
    own = {k: fn.known(k) for k in kinds}
    seconds = F.col("duration_sec")
    seen = by_role(
        trips,
        start={
            "station_id": F.col("start_station_id"),
            "date": F.to_date("started_at"),
            **own,
            "bike": F.col("bike_number"),
            "secs": seconds,
        },
        end={
            "station_id": F.col("end_station_id"),
            "date": F.to_date(returns_on),
            **own,
            "bike": F.lit(None).cast("string"),
            "secs": seconds if timed_returns else F.lit(None).cast("bigint"),
        },
    )
    if not timed_returns:
        seen = seen.where(~F.col("at_start") | (F.col("secs") > 0))
    keys = ("station_id", "date", *kinds)
    per_bike = seen.groupBy(*keys, "at_start", "bike").agg(F.count(F.lit(1)).alias("n"), F.sum("secs").alias("secs"))
    return _both_sides(per_bike, keys)


def _both_sides(per_bike: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    out, back = F.col("at_start"), ~F.col("at_start")

    def total(side: Column, value: str) -> Column:
        return F.sum(F.when(side, F.col(value)))

    return (
        per_bike.groupBy(*keys, _lone_side(*keys))
        .agg(
            F.coalesce(total(out, "n"), F.lit(0)).alias("num_checkouts"),
            F.coalesce(total(back, "n"), F.lit(0)).alias("num_returns"),
            F.try_divide(total(out, "secs"), total(out, "n")).alias("avg_out"),
            F.try_divide(total(back, "secs"), total(back, "n")).alias("avg_in"),
            F.nullif(F.count_if(out), F.lit(0)).alias("distinct_bikes_out"),
        )
        .drop("_lone_side")
    )


def station_daily(
    trips: DataFrame, stations: DataFrame, *, returns_on: str = "started_at", one_sided_null: bool = False
) -> DataFrame:
    """Checkouts, returns and net flow per station and day.

    Checkouts are rides with a positive duration; returns are all rides and are dated
    by their start unless ``returns_on="ended_at"``.  ``one_sided_null`` leaves net
    flow null where only one side has rides.
    """
    days = _station_days(trips, (), returns_on, timed_returns=False)
    return attach(days, stations, "station_id", **_PLACE).select(
        "date",
        "station_id",
        "station_name",
        "lat",
        "lng",
        "num_checkouts",
        F.col("avg_out").alias("avg_duration_sec"),
        "distinct_bikes_out",
        "num_returns",
        _net_flow(one_sided_null).alias("net_flow"),
    )


def station_daily_sample(daily: DataFrame, n: int = 200_000, seed: int = 42) -> DataFrame:
    """A reproducible sample of station days."""
    return fixed_size_sample(daily, ["date", "station_id", "num_checkouts", "num_returns"], n, seed)


def station_daily_detailed(
    trips: DataFrame, stations: DataFrame, *, returns_on: str = "started_at", one_sided_null: bool = False
) -> DataFrame:
    """As station_daily, by member and bike type; both sides need a positive duration."""
    kinds = ("member_type", "rideable_type")
    days = _station_days(trips, kinds, returns_on, timed_returns=True)
    return attach(days, stations, "station_id", **_PLACE).select(
        "date",
        "station_id",
        "station_name",
        "lat",
        "lng",
        *kinds,
        "num_checkouts",
        "num_returns",
        F.col("avg_out").alias("avg_duration_checkout_sec"),
        F.col("avg_in").alias("avg_duration_return_sec"),
        "distinct_bikes_out",
        _net_flow(one_sided_null).alias("net_flow"),
    )


def station_hour_cube(trips: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rides by station, day, hour and side: checkouts by their start, returns by their end."""
    seen = by_role(
        trips,
        **{
            end: {
                "station_id": F.col(f"{end}_station_id"),
                "date": F.to_date(time),
                "hour": F.hour(time),
                **{c: F.col(c) for c in by},
            }
            for end, time in (("start", "started_at"), ("end", "ended_at"))
        },
    )
    return seen.groupBy("station_id", "date", "hour", "at_start", *by).agg(F.count(F.lit(1)).alias("n"))


def station_hourly(trips_or_cube: DataFrame, stations: DataFrame, *, one_sided_null: bool = False) -> DataFrame:
    """Checkouts by start hour and returns by end hour per station, all durations."""
    df = trips_or_cube
    cube = station_hour_cube(df) if "started_at" in df.columns else df
    keys = ("station_id", "date", "hour")

    def total(side: Column) -> Column:
        return F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0))

    flows = cube.groupBy(*keys, _lone_side(*keys)).agg(
        total(F.col("at_start")).alias("num_checkouts"), total(~F.col("at_start")).alias("num_returns")
    )
    return attach(flows.drop("_lone_side"), stations, "station_id", **_PLACE).select(
        "date",
        "hour",
        "station_id",
        "station_name",
        "lat",
        "lng",
        "num_checkouts",
        "num_returns",
        _net_flow(one_sided_null).cast("int").alias("net_flow"),
    )
