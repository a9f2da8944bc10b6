"""Writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

# How stored tables are sorted: the columns their readers filter on come first.
LAYOUT = {
    "system_daily": ["date"],
    "system_daily_detailed": ["date", "member_type", "rideable_type"],
    "station_daily": ["station_id", "date"],
    "station_daily_sample": ["date", "station_id"],
    "station_daily_detailed": ["station_id", "date", "member_type", "rideable_type"],
    "station_hourly": ["station_id", "date", "hour"],
    "station_routes": ["start_station_id", "trip_count"],
    "routes_by_member_rideable": ["member_type", "rideable_type", "trip_count"],
    "trip_patterns": ["year_month", "hour", "weekday"],
    "trip_duration_buckets": ["year_month", "bucket_start_min"],
    "time_aggregated": ["agg_level", "agg_sort_key"],
}

# Tables read one station at a time: files hold ranges of stations, so that a reader
# opens few of them.  The others are small and read whole.
CLUSTERED = ("station_daily", "station_daily_detailed", "station_hourly")


def write_table(
    df: DataFrame, path: str, layout: list[str] | None = None, clustered: bool = False, bloom: tuple[str, ...] = ()
) -> None:
    """Replace a table, each file sorted by ``layout``, with Bloom filters on the columns of ``bloom``.

    ``clustered`` also gives each file a range of it.  Ranges over several columns
    split a hot first value, and no task sorts the whole.  A Bloom filter lets a reader
    skip row groups by a column that the order says nothing about.
    """
    if layout:
        df = (df.repartitionByRange(*layout) if clustered else df).sortWithinPartitions(*layout)
    options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom}
    df.write.mode("overwrite").options(**options).parquet(path)


# Columns that tables are read by besides those they are sorted by.
BLOOM = {"station_routes": ("end_station_id",)}


def write_trips(df: DataFrame, root: str, compact: bool = True) -> None:
    """Replace the (year, month) partitions present in ``df``; others stay as they are.

    By default a rebalancing shuffle evens out file sizes (it joins the small parts of a
    month and splits one larger than a task should write), and files are ordered by
    start, so that row groups hold ranges of it. Without ``compact`` rows are written
    where they were read.
    """
    if compact:
        df = df.hint("rebalance", "year", "month").sortWithinPartitions("year", "month", "started_at")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(root)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def export(df: DataFrame, folder: str, kind: str, *parts) -> str:
    """Writes a result as CSV under its export name; returns the path, a folder of parts with one header each."""
    path = f"{folder.rstrip('/')}/{export_name(kind, *parts)}"
    write_csv(df, path)
    return path


def export_name(kind: str, *parts) -> str:
    """File name of an export: stations by date range, calendar levels by level."""
    return "_".join([kind, *map(str, parts)]) + ".csv"
