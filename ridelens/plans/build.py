"""Building the stored summary tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens import sinks
from ridelens.plans import flows, routes, system, upkeep
from ridelens.sources.tables import read_stations

HOUR_CUBE, EDGE_CUBE, BIKE_CUBE, STATION_HOUR_CUBE = CUBES = "hour_cube", "edge_cube", "bike_cube", "station_hour_cube"

# Every table by what it is built from: one of the cubes, or another table.
_BUILDERS: dict[str, tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]] = {
    "system_daily": (HOUR_CUBE, lambda src, stations: system.system_daily(src)),
    "system_daily_detailed": (HOUR_CUBE, lambda src, stations: system.system_daily_detailed(src)),
    "station_daily": (BIKE_CUBE, flows.station_daily),
    "station_daily_sample": ("station_daily", lambda src, stations: flows.station_daily_sample(src)),
    "station_daily_detailed": (BIKE_CUBE, flows.station_daily_detailed),
    "station_hourly": (STATION_HOUR_CUBE, flows.station_hourly),
    "station_routes": (EDGE_CUBE, routes.station_routes),
    "routes_by_member_rideable": (EDGE_CUBE, routes.routes_by_member_rideable),
    "trip_patterns": (HOUR_CUBE, lambda src, stations: system.trip_patterns(src)),
    "trip_duration_buckets": (HOUR_CUBE, lambda src, stations: system.trip_duration_buckets(src)),
    "time_aggregated": (HOUR_CUBE, lambda src, stations: system.time_aggregated(src)),
}

TABLES = tuple(_BUILDERS)
ANALYTICS_TABLES = ("routes_by_member_rideable", "trip_patterns", "trip_duration_buckets")

_CUBES: dict[str, upkeep.Cube] = {
    HOUR_CUBE: system.hour_cube,
    EDGE_CUBE: routes.edge_cube,
    BIKE_CUBE: flows.bike_cube,
    STATION_HOUR_CUBE: flows.station_hour_cube,
}


def table_path(out: str, name: str) -> str:
    return f"{out.rstrip('/')}/{name}"


def _wanted(tables: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """The cubes and tables to write: those asked for and what they are made from."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"Unknown tables: {sorted(unknown)}")
    with_bases = {*tables, *(_BUILDERS[t][0] for t in tables)}
    with_bases |= {_BUILDERS[t][0] for t in with_bases if t in _BUILDERS}
    return [c for c in _CUBES if c in with_bases], [t for t in TABLES if t in with_bases]


def _write_tables(spark: SparkSession, stations: DataFrame, out: str, tables: list[str], at_once: int) -> None:
    """Tables from their stored cubes, side by side, then those made from other tables."""

    def write(name: str) -> None:
        base, make = _BUILDERS[name]
        path = table_path(out, base)
        source = upkeep.read_cube(spark, path) if base in _CUBES else spark.read.parquet(path)
        sinks.write_table(make(source, stations), table_path(out, name), sinks.LAYOUT[name], name in sinks.CLUSTERED, sinks.BLOOM.get(name, ()))

    with ThreadPoolExecutor(at_once) as pool:
        for of_cubes in (True, False):
            list(pool.map(write, [t for t in tables if (_BUILDERS[t][0] in _CUBES) == of_cubes]))


def build(
    spark: SparkSession,
    trips: DataFrame,
    stations: DataFrame,
    out: str,
    tables: tuple[str, ...] = TABLES,
    at_once: int = 4,
) -> list[str]:
    """Write the chosen summary tables under ``out``, all anew; returns the names written.

    The rides are scanned once for each of the four cubes, which are stored beside the
    tables by month and read back; that also ends the lineage there.  The system tables
    share one cube, the route tables another, the two daily station tables a third.
    What does not depend on another table is written side by side, ``at_once`` at a time.
    """
    cubes, made = _wanted(tables)
    if not {*upkeep.MONTH} <= {*trips.columns}:
        trips = trips.withColumns({"year": F.year("started_at"), "month": F.month("started_at")})
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(lambda c: upkeep.write_cube(_CUBES[c](trips, upkeep.MONTH), table_path(out, c)), cubes))
    _write_tables(spark, stations, out, made, at_once)
    return [*cubes, *made]


def build_from(
    spark: SparkSession, trips_root: str, stations_path: str, out: str, tables: tuple[str, ...] = TABLES, at_once: int = 4
) -> list[str]:
    """Bring the chosen tables under ``out`` up to date with the stored rides and dimension; returns the names written.

    Of the rides only months loaded since the cubes were built are read.  Every table
    asked for is then made anew from its cube, as its names and places come from the
    dimension, which may have changed too.
    """
    cubes, made = _wanted(tables)
    built = upkeep.bring_up_to_date(spark, trips_root, {table_path(out, c): _CUBES[c] for c in cubes}, at_once)
    _write_tables(spark, read_stations(spark, stations_path), out, made, at_once)
    return [*[c for c in cubes if table_path(out, c) in built], *made]
