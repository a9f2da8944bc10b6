from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, plan_of
from ridelens import sinks, standins
from ridelens.plans import build, explorer, overview, system
from ridelens.sources import tables


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("built"))
    trips, stations = standins.trips_li(spark, SMALL), standins.stations(spark, SMALL, places=False)
    sinks.write_trips(trips.withColumns({"year": F.year("started_at"), "month": F.month("started_at")}), f"{out}/trips")
    sinks.write_table(stations, f"{out}/stations")
    names = build.build_from(spark, f"{out}/trips", f"{out}/stations", f"{out}/tables")
    return out, names


def test_all_tables_are_written_and_equal_their_plans(spark, built):
    out, names = built
    assert set(names) == {*build.TABLES, *build.CUBES}
    trips, stations = tables.read_trips(spark, f"{out}/trips"), tables.read_stations(spark, f"{out}/stations")
    for name in build.TABLES:
        stored = spark.read.parquet(build.table_path(f"{out}/tables", name))
        base, make = build._BUILDERS[name]
        source = spark.read.parquet(build.table_path(f"{out}/tables", base)) if base == "station_daily" else trips
        wanted = make(source, stations)
        assert stored.columns == wanted.columns, name
        assert stored.exceptAll(wanted).count() == wanted.exceptAll(stored).count() == 0, name


def test_a_subset_builds_what_it_needs(spark, built, tmp_path):
    out, _ = built
    names = build.build_from(spark, f"{out}/trips", f"{out}/stations", str(tmp_path), build.ANALYTICS_TABLES)
    assert set(names) == {build.HOUR_CUBE, build.EDGE_CUBE, *build.ANALYTICS_TABLES}
    names = build.build_from(spark, f"{out}/trips", f"{out}/stations", str(tmp_path), ("station_daily_sample",))
    assert names == [build.BIKE_CUBE, "station_daily", "station_daily_sample"]
    with pytest.raises(ValueError, match="Unknown"):
        build.build_from(spark, f"{out}/trips", f"{out}/stations", str(tmp_path), ("nope",))


def test_station_slice_is_pushed_to_a_clustered_table(spark, built):
    out, _ = built
    path = build.table_path(f"{out}/tables", "station_hourly")
    df = tables.read_filtered(spark, path, "station_id", 31005)
    plan = plan_of(df)
    assert "PushedFilters: [IsNotNull(station_id), EqualTo(station_id,31005)]" in plan
    ranges = (
        spark.read.parquet(path)
        .where("station_id is not null")
        .groupBy(F.input_file_name().alias("f"))
        .agg(F.min("station_id").alias("lo"), F.max("station_id").alias("hi"))
        .orderBy("lo")
        .collect()
    )
    assert all(a.hi <= b.lo for a, b in zip(ranges, ranges[1:]))


def test_rewriting_one_month_leaves_the_others(spark, built, tmp_path):
    out, _ = built
    root = str(tmp_path / "trips")
    trips = spark.read.parquet(f"{out}/trips").where("year = 1996")
    for compact in (False, True):
        sinks.write_trips(trips, root, compact)
        sinks.write_trips(trips.where("month = 3").limit(1), root, compact)
        left = spark.read.parquet(root)
        assert left.where("month = 3").count() == 1
        assert left.where("month != 3").count() == trips.where("month != 3").count()


def test_exports(spark, built, tmp_path):
    out, _ = built
    read = lambda name: spark.read.parquet(build.table_path(f"{out}/tables", name))
    table = explorer.station_table(tables.read_stations(spark, f"{out}/stations").withColumns({"earliest_seen": F.lit(None).cast("timestamp_ntz"), "latest_seen": F.lit(None).cast("timestamp_ntz")}), read("station_daily"), read("station_daily_detailed"))
    sinks.write_csv(explorer.display_table(explorer.sorted_table(table)), str(tmp_path / "stations"))
    back = spark.read.option("header", True).csv(str(tmp_path / "stations"))
    assert back.count() == 10 and back.columns[0] == "Station Name"
    levels = overview.time_table(overview.time_summary(read("time_aggregated"), "month"))
    assert [r.agg_value for r in levels.collect()][:2] == ["January", "February"]
    assert sinks.export_name("stations", "2024-01-01", "2024-02-01") == "stations_2024-01-01_2024-02-01.csv"


def test_cube_is_smaller_than_its_calendar(spark, built):
    out, _ = built
    cube = spark.read.parquet(build.table_path(f"{out}/tables", build.HOUR_CUBE))
    days = cube.select("date").distinct().count()
    assert cube.count() <= days * 24 * 26 * 12
    assert system.system_daily(cube).count() == days
    assert list(Path(f"{out}/tables").glob("*/_SUCCESS"))
