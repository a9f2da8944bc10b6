from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL, records
from ridelens import standins
from ridelens.plans import explorer, filters, flows, stations


def test_latest_name_wins_and_both_roles_count(rides):
    trips = rides(
        {"start_station_id": 1, "start_station_name": "Old", "start_lat": 1.0, "end_station_id": 2, "started_at": "2024-01-01 00:00:00"},
        {"start_station_id": 2, "end_station_id": 1, "end_station_name": "New", "end_lat": 3.0, "started_at": "2024-02-01 00:00:00"},
        {"start_station_id": None, "end_station_id": 1, "end_station_name": "New", "end_lat": 5.0, "started_at": "2024-01-15 00:00:00"},
    )
    got = records(stations.station_dimension(trips), "station_id")
    assert [(r["station_id"], r["station_name"], r["lat"]) for r in got] == [(1, "New", 4.0), (2, None, None)]
    assert (str(got[0]["earliest_seen"]), str(got[0]["latest_seen"])) == ("2024-01-15 00:00:00", "2024-02-01 00:00:00")


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_golden_station_count(spark, folder):
    trips = standins.named_trips(spark, folder)
    assert stations.station_dimension(trips).count() == 100


def test_named_coordinates_and_latest_ones(rides):
    trips = rides(
        {"start_station_id": 1, "start_station_name": "A", "start_lat": 1.0, "start_lng": 1.0, "started_at": "2024-01-01 00:00:00"},
        {"start_station_id": 1, "start_station_name": "B", "start_lat": 2.0, "start_lng": 2.0, "started_at": "2024-01-02 00:00:00"},
        {"start_station_id": 1, "start_station_name": "C", "start_lat": 3.0, "start_lng": 3.0, "started_at": "2024-01-02 00:00:00"},
        {"start_station_id": 1, "start_station_name": None, "started_at": "2024-01-03 00:00:00"},
    )
    named = stations.named_coordinates(trips)
    assert named.count() == 3
    assert sorted(r.lat for r in stations.latest_coordinates(named).collect()) == [2.0, 3.0]


def test_enrichment_touches_only_stations_without_a_city(spark, dimension):
    base = dimension((1, "A"), (2, "B"), (3, "C"), (4, "D"))
    addresses = spark.createDataFrame([(i, f"city{i}", "S", "Z") for i in (1, 2, 3)], "station_id long, city string, state string, zip_code string")
    first = stations.enrich(base, addresses)
    assert [r["city"] for r in records(first, "station_id")] == ["city1", "city2", "city3", None]
    partly = first.withColumns(
        {
            "city": F.when(F.col("station_id") == 1, "Kept").when(F.col("station_id") == 2, "Unknown"),
            "state": F.when(F.col("station_id") == 1, "Kept"),
        }
    )
    again = records(stations.enrich(partly, addresses), "station_id")
    assert [(r["city"], r["state"]) for r in again] == [("Kept", "Kept"), ("city2", "S"), ("city3", "S"), (None, None)]


def daily_of(spark, *rows):
    return spark.createDataFrame(
        [(*r, *([None] * (7 - len(r)))) for r in rows],
        "date string, station_id long, station_name string, num_checkouts long, num_returns long, avg_duration_sec double, distinct_bikes_out long",
    ).withColumns({"date": F.col("date").cast("date"), "net_flow": F.col("num_checkouts") - F.col("num_returns")})


def test_status_is_relative_to_the_last_day(spark, dimension):
    daily = daily_of(spark, ("2024-03-31", 1, "A", 1, 1))
    base = dimension(
        (1, "A", None, None, None, "2024-03-01 00:00:00"), (2, "B", None, None, None, "2024-02-29 23:59:59"), (3, "C")
    )
    got = records(stations.station_status(base, daily), "station_id")
    assert [r["status"] for r in got] == ["Active", "Discontinued", "Discontinued"]
    profile = records(stations.station_profile(base, daily), "station_id")
    assert [r["status"] for r in profile] == ["Currently Active", "Discontinued 2024-02-29", "Discontinued"]
    assert {r["location"] for r in profile} == {"Coordinates unavailable"}
    assert {r["address"] for r in profile} == {"Unknown, Unknown Unknown"}


def test_profile_takes_the_lowest_id_of_a_name(spark, dimension):
    base = dimension((7, "A", 1.0, 2.0), (5, "A", 3.0, 4.0), (6, "B", 1.0, 1.0))
    got = stations.station_profile(base, daily_of(spark, ("2024-01-01", 5, "A", 1, 1)), "A").collect()
    assert [(r.station_id, r.location) for r in got] == [(5, "3.000000, 4.000000")]


DETAILED = "date string, station_id long, station_name string, member_type string, rideable_type string, num_checkouts long, num_returns long, avg_duration_checkout_sec double, avg_duration_return_sec double"


def detailed_of(spark, *rows):
    return spark.createDataFrame(list(rows), DETAILED).withColumn("date", F.col("date").cast("date"))


def test_electric_share_without_typed_rides(spark):
    detailed = detailed_of(
        spark,
        ("2024-01-01", 1, "A", "member", "electric_bike", 1, 0, 60.0, None),
        ("2024-01-01", 1, "A", "member", "classic_bike", 3, 0, 60.0, None),
        ("2024-01-01", 2, "B", "member", "unknown", 3, 3, 60.0, 60.0),
    )
    got = records(explorer.electric_share(detailed))
    assert [(r["station_id"], r["pct_checkouts_electric"], r["pct_returns_electric"]) for r in got] == [(1, 25.0, 0.0)]


def test_station_table(spark, dimension):
    daily = daily_of(
        spark,
        ("2024-03-31", 1, "A", 3, 1, 60.0, 2),
        ("2024-03-30", 1, "A", 1, 1, 180.0, 1),
        ("2024-03-30", 2, "B", 0, 2, None, None),
        ("2020-01-01", 3, "C", 5, 5, 60.0, 1),
    )
    base = dimension(
        *[(i, n, 1.0, 1.0, "2020-01-01 00:00:00", seen) for i, n, seen in ((1, "A", "2024-03-31 00:00:00"), (2, "B", "2024-03-30 00:00:00"), (3, "C", "2020-01-01 00:00:00"))]
    ).withColumns({"city": F.lit("X"), "zip_code": F.col("station_id").cast("string")})
    detailed = detailed_of(spark, ("2024-03-31", 1, "A", "member", "electric_bike", 2, 0, 60.0, None))
    table = explorer.station_table(base, daily, detailed, start="2024-01-01", end="2024-12-31")
    got = records(table, "station_id")
    assert [(r["total_checkouts"], r["total_returns"], r["total_trips"], r["net_flow"], r["avg_duration_min"], r["total_distinct_bikes"]) for r in got] == [
        (4, 2, 6, 2, 2.0, 3),
        (0, 2, 2, -2, 0.0, 0),
        (0, 0, 0, 0, 0.0, 0),
    ]
    assert [(r["pct_checkouts_electric"], r["status"]) for r in got] == [(100.0, "Active"), (0.0, "Active"), (None, "Discontinued")]
    assert "state" not in table.columns
    plain = explorer.station_table(base, daily)
    assert [r["pct_checkouts_electric"] for r in records(plain, "station_id")] == [0.0, 0.0, 0.0]

    def ids(**chosen):
        return sorted(r.station_id for r in explorer.station_table(base, daily, **chosen).collect())

    assert ids(statuses=("Active",)) == [1, 2] and ids(statuses=("Discontinued",)) == [3] and ids(statuses=()) == []
    assert ids(min_trips=6) == [1, 3] and ids(zip_codes=("2",)) == [2] and ids(cities=("Y",)) == []
    assert tuple(explorer.station_table_summary(table).first()) == (3, 2, 1, 8)
    assert [r.station_id for r in explorer.sorted_table(table, "net_flow", descending=False).collect()] == [2, 3, 1]
    shown = explorer.display_table(table)
    assert shown.columns[:3] == ["Station Name", "Status", "City"] and "Electric Return (%)" in shown.columns


def test_maps_and_marker_scale(spark, dimension):
    daily = daily_of(spark, ("2024-01-01", 1, "A", 3, 1, 60.0, 1), ("2024-01-02", 1, "A", 1, 1, 120.0, 1), ("2024-01-01", 2, "B", 10, 0, 60.0, 1))
    base = dimension((1, "A", 1.0, 1.0), (2, "B", None, None))
    data = explorer.map_basic(daily, base, "2024-01-01", "2024-01-02")
    got = records(data, "station_id")
    assert [(r["total_checkouts"], r["net_flow"], r["avg_duration_checkout_min"], r["lat"]) for r in got] == [(4, 2, 1.5, 1.0), (10, 10, 1.0, None)]
    weighted = explorer.map_basic(daily, base, weighted=True)
    assert records(weighted, "station_id")[0]["avg_duration_sec"] == 75.0
    marks = records(explorer.map_marker_scale(data))
    assert [(r["station_name"], r["radius"], r["metric_label"]) for r in marks] == [("A", 5.0, "Total Checkouts")]
    flat = explorer.map_marker_scale(data.where("station_id = 1"), "net_flow")
    assert flat.first().radius == 12.5
    with pytest.raises(ValueError, match="Missing"):
        explorer.map_marker_scale(data.drop("lat"))


def test_overview_halves_and_totals(spark):
    daily = daily_of(spark, ("2024-01-01", 1, "A", 3, 2, 60.0, 1), ("2024-01-02", 1, "A", 0, 2, None, None), ("2024-01-02", None, None, 9, 9, 1.0, 1))
    assert tuple(explorer.station_overview(daily).first()) == (1, 3, 1.0, 2, 1.5)
    assert tuple(explorer.station_totals(daily).first()) == (1, 3, 4, -1)


def test_filters(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "member", "unknown"), ("2024-01-02", "casual", "classic_bike"), ("2024-01-03", "unknown", "docked_bike")],
        "date string, member_type string, rideable_type string",
    ).withColumn("date", F.col("date").cast("date"))
    assert filters.of_kinds(df).count() == 3
    assert filters.of_kinds(df, members=("casual", "member", "casual")).count() == 3
    assert filters.of_kinds(df, members=("member",)).count() == 1
    assert filters.of_kinds(df, rideables=("classic_bike",)).count() == 1
    assert filters.only_kinds(df, ("member", "casual"), ("classic_bike", "electric_bike", "docked_bike")).count() == 1
    assert filters.between_dates(df, *filters.date_range("2024-01-02")).count() == 1
    assert filters.between_dates(df, *filters.date_range(("2024-01-02", "2024-01-03"))).count() == 2
    months = spark.createDataFrame([("2023-12",), ("2024-01",), ("2024-02",)], "year_month string")
    assert filters.between_months(months, "2024-01-31", "2024-02-01").count() == 2
    cities = spark.createDataFrame([("B",), ("A",), ("",), ("Unknown",), (None,), ("A",)], "city string")
    assert [r.city for r in filters.options(cities, "city").collect()] == ["A", "B"]
