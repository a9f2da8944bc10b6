"""Routes between stations and the queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.functions import columns as fn
from ridelens.operators.lookup import attach
from ridelens.operators.measures import mean_duration, mean_of, roll
from ridelens.operators.ranking import top, top_per_group, twice_average_rank, within_average_rank
from ridelens.plans.filters import of_kinds
from ridelens.schemas import USUAL_MEMBERS, USUAL_RIDEABLES

_KINDS = ("member_type", "rideable_type")
_ENDS = ("start_station_id", "end_station_id")


def edge_cube(trips: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Measures by both ends, category and whether the duration is positive."""
    return roll(_edges(trips, by), *_ENDS, *_KINDS, "positive", *by)


def _edges(trips_or_cube: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rides, or an edge cube, without round trips and unknown ends."""
    df = trips_or_cube
    if "positive" not in df.columns:
        df = df.select(
            *_ENDS,
            fn.known("member_type").alias("member_type"),
            fn.known("rideable_type").alias("rideable_type"),
            F.coalesce(F.col("duration_sec") > 0, F.lit(False)).alias("positive"),
            "duration_sec",
            *by,
        )
    return df.where("start_station_id != end_station_id")


def station_routes(trips: DataFrame, stations: DataFrame, top_n: int = 20, min_trips: int = 10) -> DataFrame:
    """Routes among the top ``top_n`` leaving their start or reaching their end.

    A station has at most as many routes as there are stations, so both ranks are
    windows over the counted routes, which are made once.
    """
    edges = roll(_edges(trips), *_ENDS).where(F.col("n") >= min_trips)
    ranks = [twice_average_rank([end], "n") for end in _ENDS]
    kept = edges.withColumns({f"_twice_{i}": r for i, r in enumerate(ranks)}).where(F.least("_twice_0", "_twice_1") <= 2 * top_n)
    return _with_ends(kept, stations).select(
        "start_station_id",
        "start_station_name",
        "start_lat",
        "start_lng",
        "end_station_id",
        "end_station_name",
        "end_lat",
        "end_lng",
        F.col("n").alias("trip_count"),
        mean_duration().alias("avg_duration_sec"),
    )


def _with_ends(edges: DataFrame, stations: DataFrame) -> DataFrame:
    for end in ("start", "end"):
        columns = {f"{end}_station_name": "station_name", f"{end}_lat": "lat", f"{end}_lng": "lng"}
        edges = attach(edges, stations, f"{end}_station_id", **columns)
    return edges


def routes_by_member_rideable(
    trips: DataFrame, stations: DataFrame, top_n: int = 100, min_trips: int = 5
) -> DataFrame:
    """The top routes of each member and bike type."""
    edges = roll(_edges(trips).where("positive"), *_ENDS, *_KINDS).where(F.col("n") >= min_trips)
    kept = within_average_rank(edges, list(_KINDS), "n", top_n)
    return _with_ends(kept, stations).select(
        "start_station_name",
        "end_station_name",
        *_KINDS,
        F.col("n").alias("trip_count"),
        mean_duration().alias("avg_duration_sec"),
    )


# --- queries over the route tables ---------------------------------------------------
def _best_first() -> list[Column]:
    return [F.desc("trip_count"), F.asc("start_station_id"), F.asc("end_station_id")]


def outbound_routes(routes: DataFrame, station_id: int | None = None, k: int = 10) -> DataFrame:
    """The busiest routes leaving each station, or one of them."""
    if station_id is not None:
        routes = routes.where(F.col("start_station_id") == station_id)
    return top_per_group(routes, ["start_station_id"], _best_first(), k)


def turned_around(routes: DataFrame) -> DataFrame:
    """Routes with start and end swapped."""
    swap = {"start": "end", "end": "start"}

    def other(name: str) -> str:
        side, _, rest = name.partition("_")
        return f"{swap[side]}_{rest}" if side in swap else name

    return routes.select(*[F.col(other(c)).alias(c) for c in routes.columns])


def inbound_routes(routes: DataFrame, station_id: int | None = None, k: int = 10) -> DataFrame:
    """The busiest routes reaching each station, turned so the station is the start."""
    return outbound_routes(turned_around(routes), station_id, k)


def top_routes(
    routes: DataFrame,
    typed_routes: DataFrame | None = None,
    top_n: int = 20,
    members: tuple[str, ...] = USUAL_MEMBERS,
    rideables: tuple[str, ...] = USUAL_RIDEABLES,
    weighted: bool = False,
) -> DataFrame:
    """The busiest routes of the system.

    Without a filter they come from the route table; otherwise the typed routes are
    summed by the names of their ends.
    """
    if set(members) == set(USUAL_MEMBERS) and set(rideables) == set(USUAL_RIDEABLES):
        return top(routes, _best_first(), top_n).withColumn(
            "route", fn.route_label(F.col("start_station_name"), F.col("end_station_name"))
        )
    names = ("start_station_name", "end_station_name")
    summed = (
        of_kinds(typed_routes, members, rideables)
        .groupBy(*names)
        .agg(
            F.sum("trip_count").alias("_sum"),
            mean_of("avg_duration_sec", "trip_count" if weighted else None).alias("avg_duration_sec"),
        )
        .withColumnRenamed("_sum", "trip_count")
    )
    order = [F.desc("trip_count"), *[F.asc_nulls_first(c) for c in names]]
    return top(summed, order, top_n).withColumn("route", fn.route_label(*[F.col(c) for c in names]))


def route_table(top: DataFrame) -> DataFrame:
    """Top routes as displayed: label, trips, minutes to one place."""
    return top.select("position", "route", "trip_count", fn.minutes(F.col("avg_duration_sec"), 1).alias("avg_duration_min"))


def route_kpis(routes: DataFrame, shown: DataFrame) -> DataFrame:
    """Number of routes, trips on the best one, mean of the first 20 shown."""
    count = routes.agg(F.count(F.lit(1))).scalar()
    return shown.agg(
        F.max("trip_count").alias("most_popular_trips"),
        F.avg(F.when(F.col("position") <= 20, F.col("trip_count"))).alias("avg_trips_top_20"),
    ).select(count.alias("total_routes"), "most_popular_trips", "avg_trips_top_20")


def route_map(routes: DataFrame, station_id: int | None = None, top_n: int = 10) -> DataFrame:
    """Lines from each station to its top destinations, weighted 2 to 8.

    Positions and the weight range count all top routes; those whose end has no
    coordinates are then left out.
    """
    best = outbound_routes(routes, station_id, top_n)
    extent = best.groupBy("start_station_id").agg(F.min("trip_count").alias("_low"), F.max("trip_count").alias("_high"))
    weight = fn.rescale(F.col("trip_count"), F.col("_low"), F.col("_high"), 2, 8)
    return (
        best.join(extent, "start_station_id")
        .where(fn.has_place(F.col("end_lat"), F.col("end_lng")))
        .select(
            "start_station_id",
            "position",
            "end_station_id",
            "end_station_name",
            "end_lat",
            "end_lng",
            "trip_count",
            weight.alias("weight"),
        )
    )


def _shown_lines(routes: DataFrame, top_n: int) -> DataFrame:
    return top(routes, _best_first(), top_n)


def _placed(end: str) -> Column:
    return fn.has_place(F.col(f"{end}_lat"), F.col(f"{end}_lng"))


def system_route_map(routes: DataFrame, top_n: int = 20) -> DataFrame:
    """Lines of the system's top routes: colour position 0 to 1 and weight 2 to 6."""
    lines = _shown_lines(routes, top_n)
    extent = lines.agg(F.struct(F.min("trip_count").alias("low"), F.max("trip_count").alias("high"))).scalar()
    trips = F.col("trip_count")
    return lines.where(_placed("start") & _placed("end")).select(
        "position",
        "start_station_name",
        "start_lat",
        "start_lng",
        "end_station_name",
        "end_lat",
        "end_lng",
        "trip_count",
        fn.rescale(trips, extent["low"], extent["high"], 0, 1).alias("color_position"),
        fn.rescale(trips, extent["low"], extent["high"], 2, 6).alias("weight"),
    )


# Map centre when no route has coordinates.
MAP_CENTER = (38.9072, -77.0369)


def _line_ends(lines: DataFrame) -> DataFrame:
    ends = [
        F.struct(
            F.lit(i).alias("end_no"),
            F.col(f"{end}_station_name").alias("station_name"),
            F.col(f"{end}_lat").alias("lat"),
            F.col(f"{end}_lng").alias("lng"),
        )
        for i, end in enumerate(("start", "end"))
    ]
    return lines.select("position", F.inline(F.array(*ends))).where(fn.has_place(F.col("lat"), F.col("lng")))


def route_centroid(routes: DataFrame, top_n: int = 20) -> DataFrame:
    """Mean position of all ends of the top routes."""
    ends = _line_ends(_shown_lines(routes, top_n))
    return ends.agg(
        F.coalesce(F.avg("lat"), F.lit(MAP_CENTER[0])).alias("center_lat"),
        F.coalesce(F.avg("lng"), F.lit(MAP_CENTER[1])).alias("center_lng"),
    )


def route_endpoints(routes: DataFrame, top_n: int = 20) -> DataFrame:
    """Each place on the system route map once, named as first seen."""
    lines = _shown_lines(routes, top_n).where(_placed("start") & _placed("end"))
    first = top_per_group(_line_ends(lines), ["lat", "lng"], [F.asc("position"), F.asc("end_no")], 1, "_place")
    return first.select("station_name", "lat", "lng")
