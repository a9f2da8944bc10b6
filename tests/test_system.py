from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL, records
from ridelens import standins
from ridelens.plans import overview, system


def test_daily_counts_positive_durations(rides):
    trips = rides(*[{"duration_sec": d} for d in (-1, 0, None, 10, 20)])
    assert [(r["trips"], r["avg_duration_sec"]) for r in records(system.system_daily(trips))] == [(2, 15.0)]


def test_bucket_limits(rides):
    trips = rides(*[{"duration_sec": d} for d in (-1, 0, 1, 299, 300, 7199, 7200, 86_399, 86_400)])
    got = records(system.trip_duration_buckets(trips), "bucket_start_min")
    assert [(r["bucket_start_min"], r["trip_count"]) for r in got] == [(0, 2), (5, 1), (115, 1), (120, 2)]


def test_levels_of_a_sunday_and_a_monday(rides):
    trips = rides({"started_at": "2024-01-07 23:59:59"}, {"started_at": "2024-01-08 00:00:00"})
    got = records(system.time_aggregated(trips), "agg_level", "agg_sort_key")
    assert [(r["agg_level"], r["agg_value"], r["agg_sort_key"], r["total_trips"]) for r in got] == [
        ("day", "2024-01-07", 19_729, 1),
        ("day", "2024-01-08", 19_730, 1),
        ("day_of_week", "Monday", 1, 1),
        ("day_of_week", "Sunday", 7, 1),
        ("month", "January", 1, 2),
        ("year", "2024", 2024, 2),
    ]
    assert all(r["net_flow"] == 0 and r["total_checkouts"] == r["total_returns"] == r["total_trips"] for r in got)


def test_every_table_from_the_cube_equals_the_one_from_rides(spark):
    trips = standins.trips_li(spark, SMALL)
    cube = system.hour_cube(trips).cache()
    for make in (
        system.system_daily,
        system.system_daily_detailed,
        system.trip_patterns,
        system.trip_duration_buckets,
        system.time_aggregated,
    ):
        direct, shared = make(trips), make(cube)
        assert direct.exceptAll(shared).count() == shared.exceptAll(direct).count() == 0, make.__name__


@pytest.mark.parametrize(
    "folder,day_rows,positive,bucket_rows,bucketed",
    [(SMALL, 5_291, 5_840, 4_336, 5_782), (MEDIUM, 25_768, 58_653, 19_295, 58_133)],
)
def test_golden_totals_agree_across_tables(spark, folder, day_rows, positive, bucket_rows, bucketed):
    trips = standins.trips_li(spark, folder)
    levels = system.time_aggregated(trips).groupBy("agg_level").agg(F.count(F.lit(1)).alias("rows"), F.sum("total_trips").alias("n"))
    found = {r.agg_level: r for r in levels.collect()}
    assert set(found) == set(system.LEVELS) and {r.n for r in found.values()} == {positive}
    assert found["day"].rows == day_rows
    assert tuple(system.trip_duration_buckets(trips).agg(F.count(F.lit(1)), F.sum("trip_count")).first()) == (bucket_rows, bucketed)
    over_a_day = trips.where(F.col("duration_sec") >= 86_400).count()
    assert bucketed + over_a_day == positive
    assert system.system_daily(trips).agg(F.sum("trips")).first()[0] == positive
    assert system.system_daily_detailed(trips).agg(F.sum("trips")).first()[0] == positive
    assert system.trip_patterns(trips).agg(F.sum("trip_count")).first()[0] == positive


BUCKETS = "year_month string, bucket_start_min int, member_type string, rideable_type string, trip_count long"


def buckets(spark, **counts):
    return spark.createDataFrame([("2024-01", int(b[1:]), "member", "unknown", n) for b, n in counts.items()], BUCKETS)


def test_duration_statistics(spark):
    got = overview.duration_stats(buckets(spark, b0=50, b5=30, b20=19, b120=1)).first()
    assert (got.total_trips, got.median_min, got.p99_min) == (100, 2.5, 25.0)
    assert got.mean_min == pytest.approx((2.5 * 50 + 7.5 * 30 + 22.5 * 19 + 122.5) / 100)
    got = overview.duration_stats(buckets(spark, b0=49, b5=51)).first()
    assert (got.median_min, got.p99_min) == (7.5, 10.0)


def test_ranges_follow_bucket_values_even_if_buckets_are_missing(spark):
    got = {r.range: (r.trip_count, r.pct) for r in overview.duration_ranges(buckets(spark, b5=1, b25=2, b60=1)).collect()}
    assert got == {
        "Quick (0–10 min)": (1, 25.0),
        "Short (10–20 min)": (0, 0.0),
        "Medium (20–30 min)": (2, 50.0),
        "Long (30–60 min)": (0, 0.0),
        "Very Long (60+ min)": (1, 25.0),
    }


def test_records_break_ties_by_date(spark):
    daily = spark.sql("select date'2024-01-01' + x date, t trips from values (0, 5), (1, 9), (2, 9), (3, 5) v(x, t)")
    got = overview.busiest_quietest(daily).first()
    assert [str(v) for v in got] == ["2024-01-02", "9", "2024-01-01", "5"]


def test_insights_keep_ties(spark):
    summary = spark.createDataFrame(
        [("Monday", 1, 5, 5, 0, 10, 60.0, 1.0), ("Tuesday", 2, 5, 4, 0, 9, 180.0, 3.0)],
        "agg_value string, agg_sort_key int, checkouts long, returns long, net_flow long, total_trips long, avg_duration_sec double, avg_duration_min double",
    )
    got = records(overview.time_insights(summary), "kind", "agg_value")
    assert [(r["kind"], r["agg_value"], r["trips"]) for r in got] == [
        ("checkouts", "Monday", 5),
        ("checkouts", "Tuesday", 5),
        ("returns", "Monday", 5),
    ]
    assert {(r["avg_duration_min"], r["total_trips"]) for r in got} == {(2.0, 19)}


def test_system_kpis_of_an_empty_range(spark, rides):
    daily = system.system_daily(rides({}))
    got = overview.system_kpis(daily, "2030-01-01", "2030-01-02").first()
    assert tuple(got) == (0, None, 0, 0.0)
    assert overview.coverage(daily).first().rows == 1
