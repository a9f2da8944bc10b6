"""The ledger of loaded files, start times by month, and tables kept by month."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, records
from ridelens.plans import build, ingest, upkeep
from ridelens.plans.stations import enrich
from ridelens.session import scratch_folder
from ridelens.sinks import write_table
from ridelens.sources import ledger, raw, tables
from test_ingest import NEW, OLD, new_line, old_line, put


@pytest.fixture
def known(dimension):
    return dimension((31000, "A", 38.5, -77.5), (31001, "B", 38.6, -77.6))


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "raw").mkdir()
    return tmp_path / "raw", str(tmp_path / "trips"), str(tmp_path / "stations")


def spoil(path: Path) -> None:
    """The same length and time, but nothing that can be read."""
    about = path.stat()
    path.write_bytes(b"x" * about.st_size)
    os.utime(path, ns=(about.st_atime_ns, about.st_mtime_ns))


def bulk(spark, folder, name, *starts):
    rows = [(s, s, 31000.0) for s in starts]
    made = spark.createDataFrame(rows, "`Start date` string, `End date` string, `Start station number` double")
    made.coalesce(1).write.mode("overwrite").parquet(str(folder / "made"))
    (folder.parent / "kept").mkdir(exist_ok=True)
    source = next((folder / "made").glob("part-*.parquet"))
    (folder / name).write_bytes(source.read_bytes())
    (folder / "made").rename(folder.parent / "kept" / f"{name}-{len(list((folder.parent / 'kept').iterdir()))}")


def test_loaded_files_are_not_opened_again(spark, folders, known):
    folder, root, _ = folders
    bulk(spark, folder, "2016.parquet", "2016-05-01 00:00:00", "2016-06-01 00:00:00")
    put(folder, "202401.csv", NEW, new_line())
    first = ingest.load_trips(spark, str(folder), root, known)
    assert sorted((Path(r.path).name, r.year, r.month, r.rides) for r in first) == [("2016.parquet", 2016, 5, 1), ("2016.parquet", 2016, 6, 1), ("202401.csv", 2024, 1, 1)]
    spoil(folder / "2016.parquet")
    spoil(folder / "202401.csv")
    put(folder, "202402.csv", NEW, new_line("x2", "2024-02-02 00:00:00", "2024-02-02 01:00:00"))
    second = ingest.load_trips(spark, str(folder), root, known, changed=True)
    assert [(Path(r.path).name, r.year, r.month) for r in second] == [("202402.csv", 2024, 2)]
    assert not ingest.load_trips(spark, str(folder), root, known, changed=True)
    assert tables.read_trips(spark, root).count() == 4


def test_changed_files_replace_the_months_they_filled(spark, folders, known):
    folder, root, _ = folders
    bulk(spark, folder, "2016.parquet", "2016-05-01 00:00:00", "2016-06-01 00:00:00")
    put(folder, "201606.csv", OLD, old_line("2016-06-09 08:00:00", "2016-06-09 08:10:00"))
    put(folder, "201607.csv", OLD, old_line("2016-07-09 08:00:00", "2016-07-09 08:10:00"))
    ingest.load_trips(spark, str(folder), root, known)
    bulk(spark, folder, "2016.parquet", "2016-05-01 00:00:00", "2016-05-02 00:00:00", "2016-06-01 00:00:00", "2016-08-01 00:00:00")
    put(folder, "201607.csv", OLD, old_line("2016-07-09 08:00:00", "2016-07-09 08:10:00"), old_line("2016-07-10 08:00:00", "2016-07-10 08:10:00"))
    assert not ingest.load_trips(spark, str(folder), root, known)
    new = ingest.load_trips(spark, str(folder), root, known, changed=True)
    assert sorted((Path(r.path).name, r.month, r.rides) for r in new) == [("2016.parquet", 5, 2), ("2016.parquet", 8, 1), ("201607.csv", 7, 2)]
    got = tables.read_trips(spark, root).groupBy("month").count().collect()
    assert {r.month: r["count"] for r in got} == {5: 2, 6: 1, 7: 2, 8: 1}


def test_misdated_rides_are_found_and_other_months_are_not_read(spark, folders, known):
    folder, root, _ = folders
    put(folder, "202401.csv", NEW, new_line(start="2024-01-05 00:00:00"), new_line("far", start="2023-06-01 12:00:00"))
    put(folder, "202402.csv", NEW, new_line("x2", start="2024-02-05 00:00:00"))
    put(folder, "202403.csv", NEW, new_line("x3", start="2024-03-05 00:00:00"), new_line("none", start="n/a"))
    ingest.load_trips(spark, str(folder), root, known)
    june = tables.read_trips(spark, root, "2023-06-01", "2023-06-30")
    assert [r.ride_id for r in june.collect()] == ["far"]
    assert re.search(r"PartitionFilters: \[.*year#\d+ \* 12", plan_of(june))
    # Neither February's nor March's file is opened.
    for month in (2, 3):
        for part in Path(root).glob(f"year=2024/month={month}/*.parquet"):
            spoil(part)
    assert [r.ride_id for r in tables.read_trips(spark, root, "2023-06-01", "2023-06-30").collect()] == ["far"]
    assert [r.ride_id for r in tables.read_trips(spark, root, end="2024-01-31").orderBy("ride_id").collect()] == ["far", "x1"]


def test_months_the_ledger_does_not_know_are_read(spark, folders, known):
    folder, root, _ = folders
    put(folder, "202401.csv", NEW, new_line(start="2024-01-05 00:00:00"))
    ingest.load_trips(spark, str(folder), root, known)
    spark.read.parquet(root).where("year = 2024").withColumn("month", F.lit(9)).drop("_file", "_load", "_unread").write.mode("append").partitionBy("year", "month").parquet(root)
    assert tables.read_trips(spark, root, "2024-01-01", "2024-01-31").count() == 2


def test_unread_values_are_counted_by_file(spark, folders, known):
    folder, root, _ = folders
    put(folder, "202401.csv", NEW, new_line(a="abc", start="yesterday"), new_line("x2", end="soon", b="7x"), new_line("x3", a="", b=" "), new_line("x4"))
    put(folder, "202402.csv", NEW, new_line("x5", start="2/3/2024 8:00", end="2/3/2024 9:00"))
    new = ingest.load_trips(spark, str(folder), root, known)
    counts = {r.month: tuple(r[f"unread_{c}"] for c in ledger.CHECKED) for r in new}
    assert counts == {1: (1, 1, 1, 1), 2: (0, 0, 0, 0)}
    assert tables.read_trips(spark, root).columns == [*tables.TRIPS.names]


def test_enrichment_survives_a_refresh(spark, folders):
    folder, root, path = folders
    put(folder, "202401.csv", NEW, new_line())
    ingest.refresh(spark, str(folder), root, path)
    places = spark.createDataFrame([(31000, "Washington", "DC", "20001")], "station_id long, city string, state string, zip_code string")
    upkeep.replace_table(enrich(tables.read_stations(spark, path), places), path)
    assert not ingest.refresh(spark, str(folder), root, path)
    put(folder, "202402.csv", NEW, new_line("x2", "2024-02-02 00:00:00", "2024-02-02 01:00:00", b="31002"))
    ingest.refresh(spark, str(folder), root, path)
    got = records(tables.read_stations(spark, path), "station_id")
    assert [(r["station_id"], r["city"], r["zip_code"]) for r in got] == [(31000, "Washington", "20001"), (31001, None, None), (31002, None, None)]
    assert str(got[0]["latest_seen"]) == "2024-02-02 00:00:00"


def test_a_refresh_reads_the_new_month_only(spark, folders):
    folder, root, path = folders
    put(folder, "202401.csv", NEW, new_line(a="31000", b="31001"))
    ingest.refresh(spark, str(folder), root, path)
    for part in Path(root).glob("year=2024/month=1/*.parquet"):
        spoil(part)
    spoil(folder / "202401.csv")
    put(folder, "202402.csv", NEW, new_line("x2", "2024-02-02 00:00:00", "2024-02-02 01:00:00", a="31005"))
    new = ingest.refresh(spark, str(folder), root, path)
    assert [r.month for r in new] == [2]
    assert [r["station_id"] for r in records(tables.read_stations(spark, path), "station_id")] == [31000, 31001, 31005]


def _raw_month(folder, year, month, seed):
    import random

    r = random.Random(seed)
    lines = []
    for i in range(120):
        start = f"{year}-{month:02d}-{r.randrange(1, 28):02d} {r.randrange(24):02d}:{r.randrange(60):02d}:00"
        if i % 17 == 0:
            start = f"{year}-{month % 12 + 1:02d}-01 00:30:00"  # the next month, in this file
        end = start[:14] + f"{r.randrange(60):02d}:30"
        lines.append(f"r{seed}{i},{r.choice(['classic_bike', 'electric_bike', ''])},{start},{end},S,{r.choice(['31000', '31001', '31002.0', ''])},E,{r.choice(['31000', '31001', '31003', ''])},38.5,-77.0,38.6,-77.1,{r.choice(['member', 'casual', ''])}")
    put(folder, f"{year}{month:02d}.csv", NEW, *lines)


def test_tables_kept_by_month_equal_a_full_build(spark, folders, tmp_path):
    folder, root, path = folders
    kept, whole = str(tmp_path / "kept"), str(tmp_path / "whole")
    chosen = tuple(t for t in build.TABLES if t != "time_aggregated")
    for month in (3, 4):
        _raw_month(folder, 2024, month, month)
    ingest.refresh(spark, str(folder), root, path)
    assert set(build.build_from(spark, root, path, kept)) == {*build.CUBES, *build.TABLES}
    assert not {*build.CUBES} & {*build.build_from(spark, root, path, kept, chosen)}
    _raw_month(folder, 2024, 5, 5)
    _raw_month(folder, 2024, 4, 9)  # April has changed
    ingest.refresh(spark, str(folder), root, path, changed=True)
    march = {p: p.read_bytes() for p in Path(root).glob("year=2024/month=3/*.parquet")}
    for part in march:
        spoil(part)
    assert set(build.build_from(spark, root, path, kept)) == {*build.CUBES, *build.TABLES}
    for part, data in march.items():
        part.write_bytes(data)
        for check in part.parent.glob(f".{part.name}.crc"):
            check.touch()
    build.build(spark, tables.read_trips(spark, root), tables.read_stations(spark, path), whole)
    for name in build.TABLES:
        a, b = (spark.read.parquet(build.table_path(out, name)) for out in (kept, whole))
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0, name
        assert a.count() or name in ("station_routes", "routes_by_member_rideable"), name


def test_a_month_that_has_lost_its_rows_is_cleared(spark, folders, tmp_path, known):
    folder, root, path = folders
    write_table(known, path)
    out = str(tmp_path / "tables")
    put(folder, "202401.csv", NEW, new_line(start="2024-01-05 00:00:00", end="2024-01-05 01:00:00"))
    put(folder, "202402.csv", NEW, new_line("x2", start="2024-02-05 00:00:00", end="2024-02-05 01:00:00"))
    ingest.load_trips(spark, str(folder), root, known)
    build.build_from(spark, root, path, out, ("system_daily",))
    put(folder, "202402.csv", NEW, new_line("x2", start="2024-02-05 02:00:00", end="2024-02-05 01:00:00"))  # no positive duration left
    ingest.load_trips(spark, str(folder), root, known, changed=True)
    build.build_from(spark, root, path, out, ("system_daily",))
    assert [str(r.date) for r in spark.read.parquet(f"{out}/system_daily").collect()] == ["2024-01-05"]


def test_tables_written_in_parts_are_raw_files_too(spark, folders, known):
    folder, root, _ = folders
    lines = spark.createDataFrame([(f"x{i}", "2024-01-05 00:00:00", "2024-01-05 01:00:00", "31000") for i in range(40)], "ride_id string, started_at string, ended_at string, start_station_id string")
    lines.repartition(4).write.option("header", True).csv(str(folder / "202401.csv"))
    files = raw.list_files(spark, str(folder)).collect()
    assert [(r.file_name, r.kind) for r in files] == [("202401.csv", "monthly")] and files[0].length > 0
    assert [r.rides for r in ingest.load_trips(spark, str(folder), root, known)] == [40]


def test_scratch_needs_a_shared_folder_off_one_machine(spark, monkeypatch):
    assert scratch_folder(spark, "x") != scratch_folder(spark, "x")
    context = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()
    session = type("Session", (), {"sparkContext": context, "conf": type("Conf", (), {"get": lambda self, k, d: d})()})()
    with pytest.raises(ValueError, match="share"):
        scratch_folder(session, "x")
