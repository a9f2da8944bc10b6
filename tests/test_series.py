from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import records
from ridelens.operators.distributions import nearest_quantile
from ridelens.plans import series

HOURLY = "date string, hour int, station_id long, num_checkouts long, num_returns long, net_flow int"


def hourly_of(spark, *rows):
    return spark.createDataFrame(list(rows), HOURLY).withColumn("date", F.col("date").cast("date"))


def test_grid_fills_absent_cells_with_zero(spark):
    hourly = hourly_of(
        spark,
        ("2024-01-01", 8, 1, 4, 1, 3),
        ("2024-01-08", 8, 1, 2, 5, -3),
        ("2024-01-07", 23, 1, 1, 0, 1),
        ("2024-01-07", 23, None, 50, 50, 0),
    )
    got = {(r.weekday, r.hour): r.avg_value for r in series.hourly_grid(hourly).collect()}
    assert len(got) == 168 and got[(1, 8)] == 3.0 and got[(7, 23)] == 1.0
    assert sum(v == 0 for v in got.values()) == 166
    net = series.hourly_grid(hourly, "Net Flow", station_id=1)
    assert {r.weekday: r.avg_value for r in net.where("hour in (8, 23)").collect() if r.avg_value} == {7: 1.0}
    same = series.hourly_grid(hourly, "no such metric").exceptAll(series.hourly_grid(hourly, "Checkouts")).count()
    assert same == 0
    assert series.hourly_grid(hourly.drop("net_flow"), "Net Flow").count() == 168


def test_grid_range_is_symmetric_and_never_empty(spark):
    grid = spark.createDataFrame([(1, -3.0), (1, 2.0), (2, 0.0)], "station_id long, avg_value double")
    assert [tuple(r) for r in series.grid_range(grid).orderBy("station_id").collect()] == [(1, -3.0, 3.0), (2, -1.0, 1.0)]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_nearest_quantile_matches_brute_force(spark, q):
    rng = random.Random(3)
    rows = [(f"g{g}", rng.randrange(12)) for g in range(25) for _ in range(g + 1)] + [("hot", rng.randrange(500)) for _ in range(3_000)]
    want = {}
    for g in {r[0] for r in rows}:
        values = sorted(v for k, v in rows if k == g)
        want[g] = values[math.floor((len(values) - 1) * q + 0.5)]
    got = nearest_quantile(spark.createDataFrame(rows, "g string, v int"), ["g"], F.col("v"), q, "x")
    assert {r.g: r.x for r in got.collect()} == want


def daily_nets(spark, nets):
    return spark.createDataFrame(
        [(i, 1, max(n, 0), max(-n, 0)) for i, n in enumerate(nets)], "i int, station_id long, num_checkouts long, num_returns long"
    ).withColumn("date", F.expr("date_add(date'2024-01-01', i)"))


def test_pressure_days_exceed_the_threshold_strictly(spark):
    daily = daily_nets(spark, [1, -1, 2, -2, 3, -3, 4, -4, 5, 5, -9])
    assert series.pressure_threshold(daily).first().threshold == 5
    got = records(series.pressure_days(daily), "date")
    assert [(r["net_flow"], r["threshold"]) for r in got] == [(-9, 5)]


@pytest.mark.parametrize("nets,kind", [([11], "departure"), ([10], "balanced"), ([-11, -10], "arrival"), ([-10], "balanced")])
def test_flow_class(spark, nets, kind):
    assert series.flow_class(daily_nets(spark, nets)).first().flow_class == kind


def test_weeks_begin_on_monday(spark):
    daily = spark.sql(
        "select date'2024-01-07' date, 3L trips, 60d avg_duration_sec union all select date'2024-01-08', 1L, 120d union all select date'2024-01-09', 3L, 240d"
    )
    got = records(series.resample(daily, "Weekly"), "date")
    assert [(str(r["date"]), r["trips"], r["avg_duration_sec"]) for r in got] == [("2024-01-01", 3, 60.0), ("2024-01-08", 4, 180.0)]
    assert records(series.resample(daily, "Weekly", weighted=True), "date")[1]["avg_duration_sec"] == 210.0
    assert [str(r["date"]) for r in records(series.resample(daily, "Monthly"))] == ["2024-01-01"]
    assert series.resample(daily, "Daily") is daily


def test_trend_skips_nan_and_null(spark):
    values = [1.0, 2.5, float("nan"), None, 6.0, 9.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, y double").withColumn(
        "date", F.expr("date_add(date'2024-01-01', i * 3)")
    )
    x = np.array([0, 3, 12, 15])
    line = np.polyfit(x, np.array([1.0, 2.5, 6.0, 9.5]), 1)
    got = [r["trend"] for r in records(series.trend_line(df, "y"), "i")]
    assert got[2] is None and got[3] is None
    assert [got[i] for i in (0, 1, 4, 5)] == pytest.approx(list(np.polyval(line, x)))


def test_series_in_minutes(spark):
    df = spark.sql("select 1L station_id, date'2024-01-01' date, 90d avg_duration_sec, 4L num_checkouts")
    assert series.station_series(df, "avg_duration_sec").first().value == 1.5
    assert series.station_series(df).first().value == 4
