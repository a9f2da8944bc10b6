"""Single bikes and stations across eras: journeys, imbalance, checkout bubbles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.functions import columns as fn
from ridelens.operators.lookup import attach
from ridelens.operators.roles import by_role
from ridelens.operators.sequences import number_and_look_back


def bike_journeys(trips: DataFrame, stations: DataFrame, bike_number: str | None = None) -> DataFrame:
    """Each bike's rides in order, numbered, with both ends' coordinates.

    ``continuous`` is 1 where a ride starts at the station the bike was last left at,
    0 where it does not, and null for a first ride or an unknown station.  Rides
    without a bike number belong to no journey.
    """
    rides = trips.where("bike_number is not null")
    if bike_number is not None:
        rides = rides.where(F.col("bike_number") == bike_number)
    rides = rides.select("ride_id", "bike_number", "started_at", "ended_at", "start_station_id", "end_station_id")
    numbered = number_and_look_back(
        rides,
        key="bike_number",
        slice_by=F.unix_date(F.to_date("started_at")),
        order=["started_at", "ended_at", "ride_id"],
        look_back="end_station_id",
        number_name="ride_number",
        previous_name="_left_at",
    )
    flagged = numbered.withColumn("continuous", (F.col("start_station_id") == F.col("_left_at")).cast("double"))
    flagged = flagged.drop("_left_at")
    flagged = attach(flagged, stations, "start_station_id", start_lat="lat", start_lng="lng")
    return attach(flagged, stations, "end_station_id", end_lat="lat", end_lng="lng")


def station_imbalance(trips: DataFrame) -> DataFrame:
    """Ends minus starts, and their ratio, for station names used in both roles."""
    roles = by_role(trips, **{end: {"start_station_name": F.col(f"{end}_station_name")} for end in ("start", "end")})
    counts = roles.groupBy("start_station_name").agg(
        F.count_if("at_start").alias("start_counts"), F.count_if(~F.col("at_start")).alias("end_counts")
    )
    both = counts.where("start_station_name is not null and start_counts > 0 and end_counts > 0")
    return both.select(
        "start_station_name",
        "start_counts",
        F.col("start_station_name").alias("end_station_name"),
        "end_counts",
        (F.col("end_counts") - F.col("start_counts")).alias("diff"),
        F.try_divide("end_counts", "start_counts").alias("ratio"),
    ).orderBy(F.desc("diff"), "start_station_name")


def _bubbles(smallest: int) -> list[Column]:
    return [
        F.greatest("num_checkouts", F.lit(smallest).cast("bigint")).alias("num_checkouts_adj"),
        fn.bubble_size(F.col("num_checkouts"), smallest).alias("sqrt_num_checkouts"),
    ]


def checkout_bubbles(trips: DataFrame, coordinates: DataFrame, smallest: int = 1000) -> DataFrame:
    """Checkouts per start station as bubbles, where (id, name) has coordinates."""
    keys = ["start_station_id", "start_station_name"]
    counts = trips.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_checkouts"))
    placed = counts.join(coordinates.select(*keys, "start_lat", "start_lng"), keys)
    return placed.select(*keys, "start_lat", "start_lng", "num_checkouts", *_bubbles(smallest))


def era_bubbles(before: DataFrame, after: DataFrame, coordinates: DataFrame, smallest: int = 1000) -> DataFrame:
    """Checkout bubbles of two tables of rides, tagged by era; ``bubbles_by_era`` reads one table once."""
    tagged = [
        checkout_bubbles(trips, coordinates, smallest).withColumn("era", F.lit(era))
        for era, trips in (("before", before), ("after", after))
    ]
    return tagged[0].unionByName(tagged[1])


def bubbles_by_era(trips: DataFrame, era: Column, smallest: int = 1000) -> DataFrame:
    """Checkout bubbles of each era (null: none), at the mean coordinates of (id, name) over all rides.

    Counts and sums of coordinates are made by era in one pass, and the sums then added up.
    """
    keys = ["start_station_id", "start_station_name"]
    sums = {f"_{c}_{name}": f(f"start_{c}") for c in ("lat", "lng") for name, f in (("sum", F.sum), ("n", F.count))}
    by_era = (
        trips.where(" and ".join(f"{key} is not null" for key in keys))
        .groupBy(*keys, era.alias("era"))
        .agg(F.count(F.lit(1)).alias("num_checkouts"), *[value.alias(name) for name, value in sums.items()])
    )
    whole = Window.partitionBy(*keys)
    mean = {f"start_{c}": F.try_divide(F.sum(f"_{c}_sum").over(whole), F.sum(f"_{c}_n").over(whole)) for c in ("lat", "lng")}
    placed = by_era.withColumns(mean).where("era is not null")
    return placed.select(*keys, "start_lat", "start_lng", "num_checkouts", *_bubbles(smallest), "era")
