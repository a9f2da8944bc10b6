"""Queries that write files and tables, load them and read them back.

The test rides become raw files in the shared scratch folder: a bulk year of each
format, monthly files of both generations, one month that a bulk year and a monthly file
share, rides that lie two months off their file, and times and ids that cannot be read.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens import sinks, standins
from ridelens.plans import build, ingest, journeys, routes, system, upkeep
from ridelens.schemas import STATIONS, require_types
from ridelens.session import scratch_folder
from ridelens.sources import ledger, raw, tables

FROM, TO = date(1998, 6, 10), date(1998, 9, 20)
BIKE = "W00042"


def _old(rides: DataFrame) -> DataFrame:
    c = F.col
    return rides.select(
        "raw",
        c("started_at").cast("string").alias("Start date"),
        c("ended_at").cast("string").alias("End date"),
        c("start_station_id").alias("Start station number"),
        c("start_station_name").alias("Start station"),
        c("end_station_id").alias("End station number"),
        c("end_station_name").alias("End station"),
        c("bike_number").alias("Bike number"),
        c("member_type").alias("Member type"),
    )


def _new(rides: DataFrame) -> DataFrame:
    c = F.col
    docked = c("rideable_type") == "docked_bike"
    return rides.select(
        "raw",
        "ride_id",
        "rideable_type",
        F.when(docked & (c("start_station_id") % 10 == 3), "n/a").otherwise(c("started_at").cast("string")).alias("started_at"),
        c("ended_at").cast("string").alias("ended_at"),
        "start_station_name",
        F.concat(c("start_station_id").cast("string"), F.lit(".0")).alias("start_station_id"),
        "end_station_name",
        F.when(docked & (c("end_station_id") % 10 == 7), "none").otherwise(c("end_station_id").cast("string")).alias("end_station_id"),
        F.lit("38.5").alias("start_lat"),
        F.lit("-77.5").alias("start_lng"),
        F.lit("38.25").alias("end_lat"),
        F.lit("-77.25").alias("end_lng"),
        c("member_type").alias("member_casual"),
    )


def _file_month(rides: DataFrame) -> DataFrame:
    """Some rides of the new generation lie in the file of two months later."""
    late = (F.col("end_station_id") % 37 == 0) & (F.year("started_at") >= 1998)
    return rides.withColumn("file_month", F.when(late, F.add_months("started_at", 2)).otherwise(F.to_date("started_at")))


def _write_raw(rides: DataFrame, folder: str, kind: str = "csv") -> None:
    """Each value of ``raw`` becomes a raw file of that name, which Spark writes as a folder of parts."""
    writer = rides.write.mode("append").partitionBy("raw")
    writer.option("header", "true").csv(folder) if kind == "csv" else writer.parquet(folder)


def put_raw_files(spark: SparkSession, folder: str, target: str) -> None:
    rides, year = _file_month(standins.named_trips(spark, folder)), F.year("started_at")
    monthly = F.concat(F.date_format("file_month", "yyyyMM"), F.lit(".csv"))
    both = rides.where((year == 1994) & (F.month("started_at") == 6) & (F.col("member_type") == "member"))
    old = [
        rides.where(year.between(1993, 1994)).withColumn("raw", F.concat(year.cast("string"), F.lit(".csv"))),
        both.withColumn("raw", F.lit("199406.csv")),
        rides.where(year.between(1996, 1997)).withColumn("raw", monthly),
    ]
    _write_raw(_old(old[0].unionByName(old[1]).unionByName(old[2])), target)
    _write_raw(_old(rides.where(year == 1995).withColumn("raw", F.lit("1995.parquet"))), target, "parquet")
    _write_raw(_old(rides.where(year < 1993).withColumn("raw", F.lit("1992.csv"))), target)
    _write_raw(_new(rides.where(year >= 1998).withColumn("raw", monthly)), target)


class Stored:
    """Raw files made of a folder of test tables, a ride table loaded from them and a dimension; each is made when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.base = scratch_folder(spark, "stored")

    @cached_property
    def raw(self) -> str:
        put_raw_files(self.spark, self.folder, f"{self.base}/raw")
        return f"{self.base}/raw"

    @cached_property
    def stations(self) -> str:
        rides = standins.trips_li(self.spark, self.folder)
        sinks.write_table(standins.stations(self.spark, self.folder, rides), f"{self.base}/stations")
        return f"{self.base}/stations"

    @cached_property
    def trips(self) -> str:
        ingest.load_trips(self.spark, self.raw, f"{self.base}/trips", tables.read_stations(self.spark, self.stations))
        return f"{self.base}/trips"

    def files(self) -> DataFrame:
        return raw.list_files(self.spark, self.raw)

    def path(self, name: str) -> str:
        return self.files().where(F.col("file_name") == name).first().path


@lru_cache(maxsize=4)
def _stored(application: str, spark: SparkSession, folder: str) -> Stored:
    return Stored(spark, folder)


def stored(spark: SparkSession, folder: str) -> Stored:
    return _stored(spark.sparkContext.applicationId, spark, folder)


# --- the way in ----------------------------------------------------------------------
def ingest_csv(s: Stored) -> DataFrame:
    return tables.read_trips(s.spark, s.trips)


def ingest_bulk_split(s: Stored) -> DataFrame:
    """Rides by partition of the months that bulk years filled."""
    bulk = ledger.read(s.spark, s.trips).where("kind = 'bulk'").select("year", "month").distinct()
    rides = tables.read_trips(s.spark, s.trips).groupBy("year", "month").agg(F.count(F.lit(1)).alias("rides"))
    return rides.join(bulk, ["year", "month"])


def load_ledger(s: Stored) -> DataFrame:
    """The ledger as the load left it, without paths and times."""
    counts = [f"unread_{c}" for c in ledger.CHECKED]
    return ledger.read(s.spark, s.trips).select(
        raw.file_name(F.col("path")).alias("file_name"), "kind", "year", "month", "rides", "first_start", "last_start", *counts
    )


def loaded_months(s: Stored) -> DataFrame:
    return tables.loaded_months(s.spark, s.trips)


def stored_months(s: Stored) -> DataFrame:
    """The zone map: what each month holds."""
    return ledger.latest_months(ledger.read(s.spark, s.trips)).drop("load")


def trips_between(s: Stored) -> DataFrame:
    """Rides of a range of dates, some of them in files of two months later."""
    return tables.read_trips(s.spark, s.trips, FROM, TO).select("ride_id", "started_at", "year", "month")


def ingest_reload(s: Stored) -> DataFrame:
    """Months after a load, a changed file, a new file and a second load: only these two are opened again."""
    spark, base = s.spark, scratch_folder(s.spark, "reload")
    source, trips = f"{base}/raw", f"{base}/trips"
    rides = _file_month(standins.named_trips(spark, s.folder)).where(F.year("started_at") == 1996)
    rides = rides.withColumn("raw", F.concat(F.date_format("file_month", "yyyyMM"), F.lit(".csv")))
    first = rides.where(F.month("started_at") <= 11)
    _write_raw(_old(first), source)
    known = tables.read_stations(spark, s.stations)
    ingest.load_trips(spark, source, trips, known)
    again = rides.where("raw in ('199603.csv', '199612.csv') and member_type is not null")
    _write_raw(_old(again), source)  # one more part of March's file, and December
    opened = ingest.load_trips(spark, source, trips, known, changed=True)
    counts = tables.read_trips(spark, trips).groupBy("year", "month").agg(F.count(F.lit(1)).alias("rides"))
    return counts.withColumn("opened", (F.col("year") * 12 + F.col("month")).isin(*[12 * r.year + r.month for r in opened]))


def stack_drift(s: Stored) -> DataFrame:
    """Files of both generations in a range of names, one left out, as one table."""
    wanted = raw.in_range(s.files().where("kind = 'monthly'"), "199711.csv", "199803.csv", ("199801.csv",))
    stacked = raw.stack(s.spark, [r.path for r in wanted.collect()])
    return stacked.select(*[F.col(f"`{c}`").alias(c.replace(" ", "_").lower()) for c in stacked.columns])


def numeric_ids(s: Stored) -> DataFrame:
    """A raw month converted to Parquet: ids as numbers, rows without them left out."""
    target = scratch_folder(s.spark, "converted")
    ingest.convert_raw(s.spark, [s.path("199805.csv")], target)
    return s.spark.read.parquet(target).select("ride_id", "start_station_id", "end_station_id")


# --- the dimension -------------------------------------------------------------------
def stored_dimension(s: Stored) -> DataFrame:
    """The stored dimension, checked against its schema, with what an absent one adds: nothing."""
    found = tables.read_stations(s.spark, s.stations)
    require_types(found, STATIONS)
    return found.unionByName(tables.read_stations(s.spark, f"{s.base}/none"), allowMissingColumns=True)


def dimension_merge(s: Stored) -> DataFrame:
    """Places that the stored dimension knows stay when it is derived anew from the rides."""
    rides = standins.named_trips(s.spark, s.folder)
    target = scratch_folder(s.spark, "dimension")
    sinks.write_table(tables.read_stations(s.spark, s.stations), target)
    derived = ingest.station_dimension(ingest.station_sightings(rides))
    upkeep.replace_table(ingest.merge_dimension(tables.read_stations(s.spark, target), derived), target)
    return tables.read_stations(s.spark, target)


# --- summaries -----------------------------------------------------------------------
def _plain_trips(s: Stored, root: str, rides: DataFrame) -> None:
    """The test rides as they are, in partitions and with a ledger as a load leaves them."""
    months = {"year": F.year("started_at"), "month": F.month("started_at")}
    load = scratch_folder(s.spark, "load").rsplit("-", 1)[1]
    placed = ingest.normalize(rides, tables.read_stations(s.spark, s.stations)).withColumns(months)
    placed = placed.withColumns({ledger.FILE: F.lit("rides"), ledger.LOAD: F.lit(load), ledger.UNREAD: F.lit(0)})
    sinks.write_trips(placed.select(*ledger.STORED.names), root)
    file = s.spark.createDataFrame([("rides", 0, None, "bulk")], "path string, length long, modified timestamp, kind string")
    ledger.append(ledger.entries(s.spark, root, load, file, None), root)


def _read_built(s: Stored, out: str, name: str) -> DataFrame:
    return s.spark.read.parquet(build.table_path(out, name))


def _built_counts(s: Stored, out: str, names: tuple[str, ...]) -> DataFrame:
    parts = [_read_built(s, out, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name in names]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


SAME = tuple(t for t in build.TABLES if t != "station_daily_sample")


def build_all(s: Stored) -> DataFrame:
    """Rows of every table built from stored rides."""
    base = scratch_folder(s.spark, "build")
    _plain_trips(s, f"{base}/trips", standins.trips_li(s.spark, s.folder))
    build.build_from(s.spark, f"{base}/trips", s.stations, f"{base}/tables")
    return _built_counts(s, f"{base}/tables", SAME)


def _in_two_loads(s: Stored, *names: str) -> str:
    """Tables built from the rides up to a month, and brought up to date when the rest is there."""
    base = scratch_folder(s.spark, "update")
    trips, out = f"{base}/trips", f"{base}/tables"
    rides, late = standins.trips_li(s.spark, s.folder), F.col("started_at") >= F.lit("1998-07-01").cast("timestamp_ntz")
    _plain_trips(s, trips, rides.where(~late))
    build.build_from(s.spark, trips, s.stations, out, names)
    _plain_trips(s, trips, rides.where(late))
    build.build_from(s.spark, trips, s.stations, out, names)
    return out


def build_update_daily(s: Stored) -> DataFrame:
    return _read_built(s, _in_two_loads(s, "station_daily"), "station_daily")


def build_update_detailed(s: Stored) -> DataFrame:
    return _read_built(s, _in_two_loads(s, "station_daily_detailed"), "station_daily_detailed")


def build_update_hourly(s: Stored) -> DataFrame:
    return _read_built(s, _in_two_loads(s, "station_hourly"), "station_hourly")


def build_update_routes(s: Stored) -> DataFrame:
    return _read_built(s, _in_two_loads(s, "station_routes"), "station_routes")


def build_analytics(s: Stored) -> DataFrame:
    """The subset of tables for the analytics pages; one of them."""
    base = scratch_folder(s.spark, "analytics")
    _plain_trips(s, f"{base}/trips", standins.trips_li(s.spark, s.folder))
    build.build_from(s.spark, f"{base}/trips", s.stations, f"{base}/tables", build.ANALYTICS_TABLES)
    return _read_built(s, f"{base}/tables", "trip_patterns")


# --- the way out ---------------------------------------------------------------------
def csv_export(s: Stored) -> DataFrame:
    """The displayed time table by month, exported and read back."""
    levels = system.time_aggregated(standins.trips_li(s.spark, s.folder), ("month",))
    shown = levels.groupBy("agg_value").agg(F.sum("total_trips").alias("trips"))
    path = sinks.export(shown, scratch_folder(s.spark, "export"), "time", "month")
    return s.spark.read.option("header", "true").csv(path).select("agg_value", F.col("trips").cast("long").alias("trips"))


# --- chosen by one value -------------------------------------------------------------
def journeys_of_bike(s: Stored) -> DataFrame:
    rides, places = standins.trips_li(s.spark, s.folder), standins.stations(s.spark, s.folder, places=False)
    return journeys.bike_journeys(rides, places, BIKE)


def inbound_of_station(s: Stored) -> DataFrame:
    """Routes that reach one station, from the stored route table."""
    base = scratch_folder(s.spark, "inbound")
    rides, places = standins.trips_li(s.spark, s.folder), standins.stations(s.spark, s.folder, places=False)
    sinks.write_table(routes.station_routes(rides, places), f"{base}/routes", sinks.LAYOUT["station_routes"], bloom=("end_station_id",))
    return routes.inbound_routes(s.spark.read.parquet(f"{base}/routes"), 31005)


MADE = {
    f.__name__: f
    for f in (
        ingest_csv, ingest_bulk_split, ingest_reload, load_ledger, loaded_months, stored_months, trips_between, stack_drift, numeric_ids, stored_dimension, dimension_merge,
        build_all, build_update_daily, build_update_detailed, build_update_hourly, build_update_routes, build_analytics, csv_export, journeys_of_bike, inbound_of_station,
    )
}
