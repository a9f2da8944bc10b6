"""Rides and stations made from the general test tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KIND_NO = {0: "classic_bike", 1: "electric_bike", 2: "docked_bike"}


@lru_cache(maxsize=64)
def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its schema is looked up once per session."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    # Without a zone whether or not the file marks its times as UTC.
    return df.select(
        *[F.col(c).cast("timestamp_ntz").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    )


def _rideable(number: Column) -> Column:
    pairs = [F.when(number == n, name) for n, name in _KIND_NO.items()]
    return F.coalesce(*pairs)


def _after(start: Column, count: Column, unit: str) -> Column:
    return start + F.expr(f"interval '1' {unit}") * count


def _bike(number: Column) -> Column:
    return F.concat(F.lit("W"), F.lpad(number.cast("string"), 5, "0"))


def trips_li(spark: SparkSession, folder: str) -> DataFrame:
    """Seven years of rides, one per line item."""
    line = _table(spark, folder, "lineitem")
    c = F.col
    whole_quantity = c("l_quantity").cast("bigint")
    odd_return = c("l_returnflag") == "R"
    ride_id = F.concat_ws(
        "-",
        *[x.cast("string") for x in (c("l_orderkey"), c("l_linenumber"), c("l_partkey"), c("l_suppkey"), whole_quantity)],
        F.round(c("l_discount") * 100).cast("bigint").cast("string"),
    )
    overnight = F.when((c("l_tax") > 0.075) & (c("l_linenumber") == 7), 86400).otherwise(0)
    base = line.select(
        ride_id.alias("ride_id"),
        _rideable(c("l_orderkey") % 4).alias("rideable_type"),
        _after(c("l_shipdate"), c("l_orderkey") % 24, "hour").alias("started_at"),
        (whole_quantity * c("l_linenumber") * 60 - 240 + overnight).cast("bigint").alias("duration_sec"),
        F.when(~((c("l_linenumber") == 7) & odd_return), 31000 + c("l_suppkey")).alias("start_station_id"),
        F.when(~((c("l_linenumber") == 6) & odd_return), 31000 + c("l_partkey") % 100).alias("end_station_id"),
        F.when(c("l_linenumber") <= 3, _bike(c("l_partkey") % 500)).alias("bike_number"),
        F.when(c("l_returnflag") == "A", "member").when(odd_return, "casual").alias("member_type"),
    )
    return base.withColumn("ended_at", _after(c("started_at"), c("duration_sec"), "second"))


def trips_ev(spark: SparkSession, folder: str) -> DataFrame:
    """One month of rides with times of day and dense routes, one per event."""
    events = _table(spark, folder, "events")
    c = F.col
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    seconds = F.floor(c("value") * 60)
    kind = c("event_type")
    base = events.select(
        c("event_id").cast("string").alias("ride_id"),
        _rideable(c("user_id") % 4).alias("rideable_type"),
        c("ts").alias("started_at"),
        F.when(kind == "error", -seconds).otherwise(seconds).cast("bigint").alias("duration_sec"),
        F.when(k != 99, 31000 + k % 10).alias("start_station_id"),
        (31000 + c("user_id") % 10).alias("end_station_id"),
        F.when(c("event_id") % 2 == 0, _bike(c("user_id"))).alias("bike_number"),
        F.when(kind.isin("click", "purchase"), "member").when(kind.isin("view", "error"), "casual").alias("member_type"),
    )
    return base.withColumn("ended_at", _after(c("started_at"), c("duration_sec"), "second"))


def stations(spark: SparkSession, folder: str, trips: DataFrame | None = None, places: bool = True) -> DataFrame:
    """The dimension: names and coordinates from suppliers, some ids or places missing.

    With ``trips``, first and last ride of either role; with ``places``, city and state
    by nation and region and a zip code.
    """
    c = F.col
    key = c("s_suppkey")
    placed = key % 17 != 16
    supplier = _table(spark, folder, "supplier").where(key % 25 != 24)
    df = supplier.select(
        (31000 + key).alias("station_id"),
        c("s_name").alias("station_name"),
        F.when(placed, 38.8 + (key % 50) * F.lit(0.004)).alias("lat"),
        F.when(placed, -77.2 + (key % 40) * F.lit(0.005)).alias("lng"),
        "s_nationkey",
    )
    if trips is not None:
        roles = F.array("start_station_id", "end_station_id")
        seen = (
            trips.select("started_at", F.explode(roles).alias("station_id"))
            .where("station_id is not null")
            .groupBy("station_id")
            .agg(F.min("started_at").alias("earliest_seen"), F.max("started_at").alias("latest_seen"))
        )
        df = df.join(seen, "station_id", "left")
    if places:
        nation, region = _table(spark, folder, "nation"), _table(spark, folder, "region")
        df = df.join(nation, c("s_nationkey") == c("n_nationkey"), "left").join(
            region, c("n_regionkey") == c("r_regionkey"), "left"
        )
        df = df.withColumns(
            {"city": c("n_name"), "state": c("r_name"), "zip_code": F.concat(F.lit("2"), F.lpad((c("s_nationkey") % 10).cast("string"), 4, "0"))}
        )
    extra = [x for x in ("earliest_seen", "latest_seen", "city", "state", "zip_code") if x in df.columns]
    return df.select("station_id", "station_name", "lat", "lng", *extra)


def named_trips(spark: SparkSession, folder: str) -> DataFrame:
    """trips_li with names and coordinates per ride; names change with the year 1998."""
    df = trips_li(spark, folder)
    known = stations(spark, folder, places=False)
    old = F.year("started_at") < 1998
    for end in ("start", "end"):
        own = known.select(
            F.col("station_id").alias(f"{end}_station_id"),
            F.col("station_name").alias("_name"),
            F.col("lat").alias(f"{end}_lat"),
            F.col("lng").alias(f"{end}_lng"),
        )
        df = df.join(own, f"{end}_station_id", "left").withColumn(
            f"{end}_station_name", F.when(old, F.concat("_name", F.lit(" (old)"))).otherwise(F.col("_name"))
        )
        df = df.drop("_name")
    return df
