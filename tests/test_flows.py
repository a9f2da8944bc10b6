from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL, records
from ridelens import standins
from ridelens.plans import flows


def one(df, **key):
    rows = [r for r in records(df) if all(r[k] == v for k, v in key.items())]
    assert len(rows) == 1, rows
    return rows[0]


def test_one_sided_days(rides, dimension):
    trips = rides({"start_station_id": 1, "end_station_id": 2})
    stations = dimension((1, "A", 1.0, 2.0))
    daily = flows.station_daily(trips, stations)
    out, back = one(daily, station_id=1), one(daily, station_id=2)
    assert (out["num_checkouts"], out["num_returns"], out["net_flow"]) == (1, 0, 1)
    assert (back["num_checkouts"], back["num_returns"], back["net_flow"]) == (0, 1, -1)
    assert (back["avg_duration_sec"], back["distinct_bikes_out"], back["station_name"]) == (None, None, None)
    literal = flows.station_daily(trips, stations, one_sided_null=True)
    assert [r["net_flow"] for r in records(literal)] == [None, None]


def test_unknown_station_keeps_a_row_per_side(rides, dimension):
    trips = rides({"start_station_id": None, "end_station_id": None}, {"start_station_id": None, "end_station_id": 1})
    for table in (flows.station_daily, flows.station_hourly, flows.station_daily_detailed):
        unknown = [r for r in records(table(trips, dimension())) if r["station_id"] is None]
        assert sorted((r["num_checkouts"], r["num_returns"]) for r in unknown) == [(0, 1), (2, 0)]


@pytest.mark.parametrize("bikes,distinct", [(["a", "a"], 1), (["a", None], 2), ([None], 1), ([None, None, "a", "b"], 3)])
def test_distinct_bikes_count_null_once(rides, dimension, bikes, distinct):
    trips = rides(*[{"start_station_id": 1, "end_station_id": 2, "bike_number": b} for b in bikes])
    assert one(flows.station_daily(trips, dimension()), station_id=1)["distinct_bikes_out"] == distinct


def test_positive_durations_count_for_checkouts_only(rides, dimension):
    trips = rides(*[{"start_station_id": 1, "end_station_id": 2, "duration_sec": d} for d in (-1, 0, 1, None)])
    daily = flows.station_daily(trips, dimension())
    assert one(daily, station_id=1)["num_checkouts"] == 1
    assert one(daily, station_id=2)["num_returns"] == 4
    detailed = flows.station_daily_detailed(trips, dimension())
    assert one(detailed, station_id=2)["num_returns"] == 1
    hourly = flows.station_hourly(trips, dimension())
    assert sum(r["num_checkouts"] for r in records(hourly)) == 4


def test_ride_over_midnight(rides, dimension):
    trips = rides(
        {"start_station_id": 1, "end_station_id": 2, "started_at": "2024-01-01 23:50:00", "ended_at": "2024-01-02 00:10:00"}
    )
    assert str(one(flows.station_daily(trips, dimension()), station_id=2)["date"]) == "2024-01-01"
    assert str(one(flows.station_daily(trips, dimension(), returns_on="ended_at"), station_id=2)["date"]) == "2024-01-02"
    back = one(flows.station_hourly(trips, dimension()), station_id=2)
    assert (str(back["date"]), back["hour"], back["net_flow"]) == ("2024-01-02", 0, -1)
    with pytest.raises(ValueError):
        flows.station_daily(trips, dimension(), returns_on="arrived")


def test_detailed_names_missing_categories_and_averages_both_sides(rides, dimension):
    trips = rides(
        {"start_station_id": 1, "end_station_id": 1, "duration_sec": 100},
        {"start_station_id": 1, "end_station_id": 2, "duration_sec": 300},
    )
    row = one(flows.station_daily_detailed(trips, dimension()), station_id=1)
    assert (row["member_type"], row["rideable_type"]) == ("unknown", "unknown")
    assert (row["avg_duration_checkout_sec"], row["avg_duration_return_sec"]) == (200.0, 100.0)


# Row counts and sums agreed between two engines beforehand.
GOLDEN = {
    SMALL: dict(rows=11_003, null_rows=572, out=5_840, back=6_000, bikes=5_612, one_sided=10_834, negative=5_746, named=5_393),
    MEDIUM: dict(
        rows=94_109, null_rows=3_445, out=58_653, back=60_000, bikes=55_616, one_sided=83_618, negative=43_461, named=87_088
    ),
}


@pytest.mark.parametrize("folder", list(GOLDEN))
def test_golden_station_days(spark, folder):
    trips, stations = standins.trips_li(spark, folder), standins.stations(spark, folder, places=False)
    got = flows.station_daily(trips, stations).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.isnull("station_id")).alias("null_rows"),
        F.sum("num_checkouts").alias("out"),
        F.sum("num_returns").alias("back"),
        F.sum("distinct_bikes_out").alias("bikes"),
        F.count_if((F.col("num_checkouts") == 0) | (F.col("num_returns") == 0)).alias("one_sided"),
        F.count_if(F.col("net_flow") < 0).alias("negative"),
        F.count("station_name").alias("named"),
    )
    assert got.first().asDict() == GOLDEN[folder]


@pytest.mark.parametrize("folder,rows,total", [(SMALL, 11_927, 11_948), (MEDIUM, 118_513, 118_458)])
def test_golden_station_hours(spark, folder, rows, total):
    trips, stations = standins.trips_li(spark, folder), standins.stations(spark, folder, places=False)
    got = flows.station_hourly(trips, stations).agg(F.count(F.lit(1)), F.sum(F.abs("net_flow"))).first()
    assert tuple(got) == (rows, total)


def test_sample_is_exact_repeatable_and_spread(spark):
    days = spark.range(5_000).select(
        F.expr("date_add(date'2020-01-01', cast(id % 500 as int))").alias("date"),
        (F.col("id") / 500).cast("bigint").alias("station_id"),
        F.col("id").alias("num_checkouts"),
        F.lit(0).alias("num_returns"),
    )
    first = {r.num_checkouts for r in flows.station_daily_sample(days, 700).collect()}
    again = {r.num_checkouts for r in flows.station_daily_sample(days.repartition(7), 700).collect()}
    other = {r.num_checkouts for r in flows.station_daily_sample(days, 700, seed=7).collect()}
    assert len(first) == 700 and first == again and first != other
    assert flows.station_daily_sample(days, 9_999).count() == 5_000
    assert flows.station_daily_sample(days, 1).count() == 1
