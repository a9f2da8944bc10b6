from __future__ import annotations

import os
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, records
from ridelens.plans import ingest
from ridelens.schemas import CANONICAL, STATIONS, TRIPS
from ridelens.sources import calendar, raw, tables

OLD = "Start date,End date,Start station number,Start station,End station number,End station,Bike number,Member type\n"
NEW = "ride_id,rideable_type,started_at,ended_at,start_station_name,start_station_id,end_station_name,end_station_id,start_lat,start_lng,end_lat,end_lng,member_casual\n"


@pytest.fixture
def folders(tmp_path):
    raw_folder = tmp_path / "raw"
    raw_folder.mkdir()
    return raw_folder, str(tmp_path / "trips"), str(tmp_path / "stations")


def put(folder: Path, name: str, header: str, *lines: str) -> None:
    (folder / name).write_text(header + "".join(f"{line}\n" for line in lines))


@pytest.fixture
def known(dimension):
    return dimension((31000, "A", 38.5, -77.5), (31001, "B", 38.6, -77.6))


def old_line(start="2017-05-01 08:00:00", end="2017-05-01 08:10:30", a="31000", b="31001.0"):
    return f"{start},{end},{a},A st,{b},B st,W1,Member"


def new_line(ride="x1", start="2024-01-31 23:50:00", end="2024-02-01 00:20:00.500", a="31000.0", b="31001", member="casual"):
    return f"{ride},electric_bike,{start},{end},A st,{a},B st,{b},1.5,2.5,3.5,,{member}"


def test_both_generations_come_out_canonical(spark, folders, known):
    folder, root, _ = folders
    put(folder, "201705.csv", OLD, old_line())
    put(folder, "202401.csv", NEW, new_line())
    assert ingest.load_trips(spark, str(folder), root, known)
    trips = tables.read_trips(spark, root)
    assert [(f.name, f.dataType) for f in trips.schema] == [(f.name, f.dataType) for f in TRIPS]
    old, new = records(trips, "year")
    assert (old["duration_sec"], old["start_station_id"], old["end_station_id"]) == (630, 31000, 31001)
    assert (old["start_lat"], old["end_lng"], old["ride_id"], old["member_type"]) == (38.5, -77.6, None, "Member")
    assert (old["day"], old["hour"], old["weekday"], old["year"], old["month"]) == (1, 8, 1, 2017, 5)
    # The file's own coordinates stand, also where one is missing.
    assert (new["start_lat"], new["end_lat"], new["end_lng"]) == (1.5, 3.5, None)
    assert (new["duration_sec"], new["member_type"], new["year"], new["month"]) == (1800, "casual", 2024, 1)


def test_reloading_adds_nothing_and_only_missing_months_load(spark, folders, known):
    folder, root, _ = folders
    put(folder, "202401.csv", NEW, new_line())
    assert ingest.load_trips(spark, str(folder), root, known)
    assert not ingest.load_trips(spark, str(folder), root, known)
    put(folder, "202401.csv", NEW, new_line(), new_line("x2"))
    put(folder, "202402.csv", NEW, new_line("x3", "2024-02-02 00:00:00", "2024-02-02 01:00:00"))
    put(folder, "readme.csv", "a\n", "1")
    put(folder, "20240.csv", "a\n", "1")
    ingest.load_trips(spark, str(folder), root, known)
    assert sorted(r.ride_id for r in tables.read_trips(spark, root).collect()) == ["x1", "x3"]
    ingest.load_trips(spark, str(folder), root, known, missing_only=False)
    assert sorted(r.ride_id for r in tables.read_trips(spark, root).collect()) == ["x1", "x2", "x3"]
    assert sorted((r.year, r.month) for r in tables.loaded_months(spark, root).collect()) == [(2024, 1), (2024, 2)]


def test_bulk_year_splits_by_start_and_yields_to_monthly_files(spark, folders, known):
    folder, root, _ = folders
    bulk = spark.createDataFrame(
        [("2017-05-01 00:00:00", "2017-05-01 00:10:00", 31000.0), ("2017-06-30 23:59:00", "2017-07-01 00:10:00", 31001.0), ("bad", "bad", 31001.0)],
        "`Start date` string, `End date` string, `Start station number` double",
    )
    bulk.coalesce(1).write.parquet(str(folder / "made"))
    made = next((folder / "made").glob("*.parquet"))
    (folder / "2017.parquet").write_bytes(made.read_bytes())
    put(folder, "201705.csv", OLD, old_line("2017-05-09 08:00:00", "2017-05-09 08:10:00"))
    ingest.load_trips(spark, str(folder), root, known)
    got = records(tables.read_trips(spark, root), "started_at")
    assert [(str(r["started_at"]), r["year"], r["month"]) for r in got] == [
        ("None", None, None),
        ("2017-05-09 08:00:00", 2017, 5),
        ("2017-06-30 23:59:00", 2017, 6),
    ]
    # A loaded bulk file is not opened again, unless it has changed; then the monthly file's month still stands.
    assert not ingest.load_trips(spark, str(folder), root, known)
    os.utime(folder / "2017.parquet", (1, 1))
    assert ingest.load_trips(spark, str(folder), root, known, changed=True)
    assert tables.read_trips(spark, root).where("year is not null").count() == 2
    assert not ingest.load_trips(spark, str(folder), root, known, changed=True)


def test_same_stem_in_two_formats_loads_once(spark, folders):
    files = spark.createDataFrame(
        [(f"/r/{n}", n) for n in ("202401.csv", "202401.parquet", "2015.csv", "202402.csv", "notes.csv")], "path string, file_name string"
    )
    loaded = spark.createDataFrame([(2024, 2)], "year int, month int")
    assert sorted(r.path for r in ingest.pick_files(raw.with_file_kind(files), loaded).collect()) == ["/r/2015.csv", "/r/202401.parquet"]


def test_refresh_builds_the_dimension_from_all_rides(spark, folders):
    folder, root, path = folders
    put(folder, "202401.csv", NEW, new_line())
    ingest.refresh(spark, str(folder), root, path)
    got = records(tables.read_stations(spark, path), "station_id")
    assert [(r["station_id"], r["station_name"], r["lat"]) for r in got] == [(31000, "A st", 1.5), (31001, "B st", 3.5)]
    put(folder, "201705.csv", OLD, old_line())
    ingest.refresh(spark, str(folder), root, path)
    trips = tables.read_trips(spark, root)
    # The second load found coordinates in the dimension the first one made.
    assert trips.where("year = 2017").first().start_lat == 1.5
    assert str(records(tables.read_stations(spark, path), "station_id")[0]["earliest_seen"]) == "2017-05-01 08:00:00"


def test_empty_sources(spark, tmp_path):
    missing = str(tmp_path / "nothing")
    assert tables.read_stations(spark, missing).schema == STATIONS
    assert tables.loaded_months(spark, missing).count() == 0
    assert not ingest.load_trips(spark, missing, missing, tables.read_stations(spark, missing))


def test_bad_ids_and_times(spark, folders, known):
    folder, root, _ = folders
    put(folder, "202401.csv", NEW, new_line(a="abc", start="yesterday"))
    with pytest.raises(Exception):
        ingest.load_trips(spark, str(folder), root, known, strict=True)
    ingest.load_trips(spark, str(folder), root, known)
    row = tables.read_trips(spark, root).first()
    assert (row.start_station_id, row.started_at, row.duration_sec, row.day) == (None, None, None, None)


def test_typed_times_and_missing_columns(spark, known):
    df = spark.sql("select timestamp_ntz'2024-01-07 10:00:00' started_at, 5L duration_sec, 'MEMBER' member_type")
    got = ingest.normalize(df, known, fold_case=True)
    assert got.columns == CANONICAL.names
    assert (got.first().weekday, got.first().duration_sec, got.first().member_type) == (7, 5, "member")
    with pytest.raises(ValueError, match="started_at"):
        ingest.normalize(spark.sql("select 1L start_station_id"), known)


def test_same_header_files_are_read_together_and_drift_is_stacked(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "x,y\n3,\n"), ("c.csv", "y,z\n5,6\n")):
        (tmp_path / name).write_text(text)
    spark.sql("select 7L x, 8.5d z").coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv", "d.parquet")]
    assert [len(b.paths) for b in raw.batches(spark, paths)] == [2, 1, 1]
    got = records(raw.stack(spark, paths), "x", "y")
    assert [(r["x"], r["y"], r["z"]) for r in got] == [(None, "5", "6"), ("1", "2", None), ("3", None, None), ("7", None, "8.5")]


def test_quoted_text_in_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n"a, ""b""",2\n')
    assert raw.stack(spark, [str(tmp_path / "a.csv")]).first().x == 'a, "b"'


def test_raw_conversion_drops_rows_without_numeric_ids(spark, tmp_path):
    put(tmp_path, "a.csv", OLD, old_line(), old_line(a="n/a"), old_line(b=""))
    ingest.convert_raw(spark, [str(tmp_path / "a.csv")], str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 1 and got.first()["Start station number"] == 31000.0


def test_file_listing_ranges_and_exclusions(spark, tmp_path):
    for name in ("202003.csv", "202005.csv", "202102.csv", "notes.txt", "201801.parquet"):
        (tmp_path / name).write_text("a\n")
    (tmp_path / "__MACOSX").mkdir()
    (tmp_path / "__MACOSX" / "202006.csv").write_text("a\n")
    files = raw.list_files(spark, str(tmp_path))
    assert sorted(r.file_name for r in files.collect()) == ["201801.parquet", "202003.csv", "202005.csv", "202102.csv"]
    assert {r.file_name for r in raw.in_range(files, last="202003.csv").collect()} == {"201801.parquet", "202003.csv"}
    late = raw.in_range(files, first="202005.csv", without=("202102.csv",))
    assert [r.file_name for r in late.collect()] == ["202005.csv"]


def test_calendars(spark):
    def months(df):
        return sorted((r.year, r.month) for r in df.collect())

    loaded = spark.createDataFrame([(2023, 10), (2023, 12)], "year int, month int")
    assert months(calendar.months_after_latest(loaded, date(2024, 2, 9))) == [(2024, 1), (2024, 2)]
    assert months(calendar.months_after_latest(loaded, date(2023, 12, 9))) == []
    assert months(calendar.months_not_loaded(loaded)) == [(2023, 11)]
    wanted = calendar.months_from(spark, date(2023, 11, 30), date(2024, 1, 1))
    assert months(wanted) == [(2023, 11), (2023, 12), (2024, 1)]
    assert months(calendar.months_not_loaded(loaded, wanted)) == [(2023, 11), (2024, 1)]
    stems = [r.file_stem for r in calendar.expected_files(calendar.years_from(spark, 2016, 2018)).orderBy("year", "month").collect()]
    assert stems[:3] == ["2016", "2017", "201801"] and len(stems) == 14


def test_date_range_reaches_the_scan(spark, folders, known):
    folder, root, _ = folders
    put(folder, "202401.csv", NEW, new_line(start="2024-01-01 00:00:00"), new_line("x2", start="2024-02-01 00:10:00"))
    put(folder, "202403.csv", NEW, new_line("x3", start="2024-03-01 00:00:00"))
    ingest.load_trips(spark, str(folder), root, known)
    ranged = tables.read_trips(spark, root, "2024-01-15", "2024-02-01")
    # The ride of 1 February lies in the January file's partition.
    assert [r.ride_id for r in ranged.collect()] == ["x2"]
    by_default = plan_of(tables.read_trips(spark, root, "2024-01-15", "2024-02-01"))
    assert "PartitionFilters: [" in by_default
    pruned = tables.read_trips(spark, root, "2024-01-15", "2024-02-01", slack_months=0)
    assert [r.ride_id for r in pruned.collect()] == ["x2"]
    plan = plan_of(pruned)
    assert "PushedFilters: [IsNotNull(started_at), GreaterThanOrEqual(started_at" in plan
    assert "PartitionFilters: [isnotnull(year" in plan


def test_equal_names_in_two_folders_keep_the_last_path(spark):
    files = spark.createDataFrame([("/r/b/202401.csv", "202401.csv"), ("/r/a/202401.csv", "202401.csv")], "path string, file_name string")
    assert [(r.path, r.passed_over) for r in ingest.pick_files(raw.with_file_kind(files)).collect()] == [("/r/b/202401.csv", 1)]


def test_time_layouts(spark):
    texts = ["2015-03-05 08:00:00", "3/5/2015 8:00", "2015/03/05 08:00:00", "n/a"]
    df = spark.createDataFrame([(t,) for t in texts], "started_at string")
    stations = spark.createDataFrame([], "station_id long, station_name string, lat double, lng double")
    got = [str(r.started_at) for r in ingest.normalize(df, stations).select("started_at").collect()]
    assert got == ["2015-03-05 08:00:00"] * 3 + ["None"]
