from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import records
from ridelens.functions import columns as fn
from ridelens.schemas import STATIONS, require, require_types


def test_station_key_reads_every_form(spark):
    df = spark.createDataFrame([("31000",), ("31000.0",), (None,)], "id string")
    assert [r[0] for r in df.select(fn.station_key(F.col("id"))).collect()] == [31000, 31000, None]
    df = spark.createDataFrame([(31000.0,), (12345678.0,), (None,)], "id double")
    assert [r[0] for r in df.select(fn.station_key(F.col("id"), "double")).collect()] == [31000, 12345678, None]


@pytest.mark.parametrize("kind,value", [("string", "abc"), ("double", 1.5), ("string", "31000.5")])
def test_station_key_strictness(spark, kind, value):
    df = spark.createDataFrame([(value,)], f"id {kind}")
    assert df.select(fn.station_key(F.col("id"), kind, strict=False)).first()[0] is None
    with pytest.raises(Exception):
        df.select(fn.station_key(F.col("id"), kind)).collect()


def test_weekday_is_iso_and_labelled_right(spark):
    df = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-07')) d").select(
        fn.iso_weekday(F.col("d")).alias("n")
    )
    got = df.select("n", fn.weekday_label(F.col("n")).alias("l")).orderBy("n").collect()
    assert [(r.n, r.l) for r in got] == list(zip(range(1, 8), ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]))


def test_duration_bucket_equals_two_step_form_for_every_second(spark):
    seconds = spark.range(1, 86_400)
    minutes = F.col("id") / 60
    two_step = F.when(minutes >= 120, F.lit(120)).otherwise((F.floor(minutes / 5) * 5).cast("int"))
    assert seconds.where(fn.duration_bucket(F.col("id")) != two_step).count() == 0


def test_bucket_labels(spark):
    df = spark.createDataFrame([(0,), (115,), (120,)], "b int")
    assert [r[0] for r in df.select(fn.bucket_label(F.col("b"))).collect()] == ["0–5", "115–120", "120+"]


def test_rescale_uses_midpoint_when_flat(spark):
    df = spark.createDataFrame([(1, 1, 1), (5, 1, 9), (None, 1, 9)], "v int, lo int, hi int")
    got = [r[0] for r in df.select(fn.rescale(F.col("v"), F.col("lo"), F.col("hi"), 5, 20)).collect()]
    assert got == [12.5, 12.5, None]


def test_metric_labels(spark):
    df = spark.createDataFrame([("net_flow",), ("pct_checkouts_electric",)], "m string")
    assert [r[0] for r in df.select(fn.metric_label(F.col("m"))).collect()] == ["Net Flow", "Pct Checkouts Electric"]


def test_share_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 4)], "a int, b int")
    assert [r[0] for r in df.select(fn.share(F.col("a"), F.col("b"))).collect()] == [0.0, 25.0]


def test_bubble_size_has_a_floor(spark):
    df = spark.createDataFrame([(10,), (1600,)], "n bigint")
    assert [r[0] for r in df.select(fn.bubble_size(F.col("n"))).collect()] == [pytest.approx(1000**0.5), 40.0]


def test_address_falls_back_over_places(spark):
    texts = [
        '{"address": {"city": "A", "town": "B", "state": "S", "postcode": "1"}}',
        '{"address": {"city": "", "village": "C"}}',
        '{"address": {"county": "D", "state": ""}}',
        '{"address": {}}',
        "{}",
        "broken",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, record string")
    got = records(df.select("i", *[c.alias(n) for n, c in fn.address_columns(F.col("record")).items()]), "i")
    assert [r["city"] for r in got] == ["A", "C", "D", "Unknown", "Unknown", "Unknown"]
    assert [r["state"] for r in got] == ["S", "Unknown", "", "Unknown", "Unknown", "Unknown"]
    assert [r["zip_code"] for r in got] == ["1"] + ["Unknown"] * 5


def test_coordinates_text_and_validity(spark):
    df = spark.createDataFrame([(38.5, -77.0), (None, -77.0), (0.0, 1.0)], "lat double, lng double")
    got = df.select(fn.place_text(F.col("lat"), F.col("lng")), fn.has_place(F.col("lat"), F.col("lng"))).collect()
    assert [tuple(r) for r in got] == [
        ("38.500000, -77.000000", True),
        ("Coordinates unavailable", False),
        ("0.000000, 1.000000", False),
    ]


def test_seconds_between_keeps_wall_clock(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 01:30:00' a, timestamp_ntz'2024-03-10 03:30:00.9' b")
    assert df.select(fn.seconds_between(F.col("a"), F.col("b"))).first()[0] == 7200
    assert df.select(fn.seconds_between(F.col("b"), F.col("a"))).first()[0] == -7200


def test_schema_guards(spark):
    df = spark.createDataFrame([("1",)], "station_id string")
    with pytest.raises(ValueError, match="Missing"):
        require(df, "lat")
    with pytest.raises(ValueError):
        require_types(df, STATIONS)
