"""The station dimension: derivation, enrichment, status and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.functions import columns as fn
from ridelens.operators.lookup import attach
from ridelens.operators.ranking import top_per_group, top_ties_per_group
from ridelens.operators.roles import by_role
from ridelens.schemas import PLACE_COLUMNS, STATIONS, require_types

ACTIVE_DAYS = 30


def station_sightings(trips: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sightings by station id and name, as sums that can be merged.

    A ride is a sighting of both its stations, dated by its start.
    """
    ids = {end: fn.station_key(F.col(f"{end}_station_id"), dict(trips.dtypes)[f"{end}_station_id"]) for end in ("start", "end")}

    def seen(end: str) -> dict[str, Column]:
        return {
            "station_id": ids[end],
            "station_name": F.col(f"{end}_station_name"),
            "lat": F.col(f"{end}_lat").cast("double"),
            "lng": F.col(f"{end}_lng").cast("double"),
            "seen_at": F.col("started_at").cast("timestamp_ntz"),
            **{c: F.col(c) for c in by},
        }

    sums = [f(c).alias(f"{c}_{name}") for c in ("lat", "lng") for name, f in (("sum", F.sum), ("n", F.count))]
    return (
        by_role(trips, seen("start"), seen("end"))
        .where("station_id is not null")
        .groupBy("station_id", "station_name", *by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *sums,
            F.min("seen_at").alias("earliest_seen"),
            F.max("seen_at").alias("latest_seen"),
        )
    )


def station_dimension(trips_or_sightings: DataFrame) -> DataFrame:
    """One row per station id: latest name, mean coordinates, first and last ride."""
    df = trips_or_sightings
    sightings = df if "lat_sum" in df.columns else station_sightings(df)
    named = sightings.groupBy("station_id", "station_name").agg(
        *[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(c) for c in ("lat", "lng")],
        F.min("earliest_seen").alias("earliest_seen"),
        F.max("latest_seen").alias("latest_seen"),
    )
    latest = [F.desc_nulls_last("latest_seen"), F.asc_nulls_first("station_name")]
    dimension = top_per_group(named, ["station_id"], latest, 1, "_place").select(*STATIONS.names)
    require_types(dimension, STATIONS)
    return dimension


def merge_dimension(known: DataFrame, derived: DataFrame) -> DataFrame:
    """A newly derived dimension with what else is known of its stations, such as their places."""
    others = {c: c for c in known.columns if c not in derived.columns}
    return attach(derived, known, "station_id", **others) if others else derived


def named_coordinates(trips: DataFrame) -> DataFrame:
    """Mean start coordinates and first and last start per (id, name); nulls left out."""
    return (
        trips.where("start_station_id is not null and start_station_name is not null")
        .groupBy("start_station_id", "start_station_name")
        .agg(
            F.avg("start_lat").alias("start_lat"),
            F.avg("start_lng").alias("start_lng"),
            F.min("started_at").alias("earliest"),
            F.max("started_at").alias("latest"),
        )
    )


def latest_coordinates(named: DataFrame) -> DataFrame:
    """Coordinates under each id's latest name; names that tie for latest are all kept."""
    return top_ties_per_group(named, ["start_station_id"], F.desc_nulls_last("latest")).select(
        F.col("start_station_id").alias("station_id"), F.col("start_lat").alias("lat"), F.col("start_lng").alias("lng")
    )


# --- enrichment ----------------------------------------------------------------------
def read_addresses(records: DataFrame, record: str = "record") -> DataFrame:
    """city, state and zip code of JSON address records, other columns kept."""
    parts = fn.address_columns(F.col(record))
    return records.select(*[c for c in records.columns if c != record], *[c.alias(n) for n, c in parts.items()])


def enrich(stations: DataFrame, addresses: DataFrame) -> DataFrame:
    """Fill city, state and zip code of stations that lack a city.

    ``addresses`` has one row per station_id.  A station whose city is neither null
    nor "Unknown" keeps all three values.
    """
    found = {f"_{c}": c for c in PLACE_COLUMNS}
    joined = attach(stations, addresses, "station_id", **found)
    if "city" not in stations.columns:
        return joined.withColumnsRenamed(found)
    lacking = F.coalesce(F.col("city") == "Unknown", F.lit(True))
    old = {c: F.col(c) if c in stations.columns else F.lit(None).cast("string") for c in PLACE_COLUMNS}
    others = [c for c in stations.columns if c not in PLACE_COLUMNS]
    return joined.select(
        *others, *[F.when(lacking, F.col(f"_{c}")).otherwise(old[c]).alias(c) for c in PLACE_COLUMNS]
    )


# --- status and profile --------------------------------------------------------------
def is_active(daily: DataFrame) -> Column:
    """Whether latest_seen lies within the last 30 days of the daily data."""
    last_day = daily.agg(F.max("date")).scalar()
    return F.coalesce(F.to_date("latest_seen") >= F.date_sub(last_day, ACTIVE_DAYS), F.lit(False))


def station_status(stations: DataFrame, daily: DataFrame) -> DataFrame:
    return stations.withColumn("status", F.when(is_active(daily), "Active").otherwise("Discontinued"))


def station_profile(stations: DataFrame, daily: DataFrame, name: str | None = None) -> DataFrame:
    """Facts shown for a station picked by name; of ids sharing a name, the lowest."""
    if name is not None:
        stations = stations.where(F.col("station_name") == name)
    first = top_per_group(stations, ["station_name"], [F.asc("station_id")], 1, "_place")
    place = {c: F.coalesce(F.col(c), F.lit("Unknown")) if c in stations.columns else F.lit("Unknown") for c in PLACE_COLUMNS}
    ended = F.concat(F.lit("Discontinued "), F.to_date("latest_seen").cast("string"))
    return first.select(
        "station_name",
        "station_id",
        fn.place_text(F.col("lat"), F.col("lng")).alias("location"),
        F.concat(place["city"], F.lit(", "), place["state"], F.lit(" "), place["zip_code"]).alias("address"),
        F.to_date("earliest_seen").alias("first_observed"),
        F.when(is_active(daily), "Currently Active").otherwise(F.coalesce(ended, F.lit("Discontinued"))).alias("status"),
    )
