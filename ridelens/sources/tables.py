"""Reading stored tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.schemas import STATIONS, TRIPS
from ridelens.sources import ledger


def read_trips(spark: SparkSession, root: str, start=None, end=None, slack_months: int | None = None) -> DataFrame:
    """The stored rides, optionally those that started from ``start`` to ``end``.

    The date range reaches the scan as a filter on started_at, which skips row groups.
    Monthly files keep their file's month, however far from it a ride started, so
    partitions are pruned by what the ledger says of their start times: months whose
    first and last start lie outside are not listed. Months the ledger does not know are
    read. ``slack_months`` prunes by the calendar too, and loses rides that lie further
    off their month than that.
    """
    trips = spark.read.schema(TRIPS).parquet(root)
    if start is None and end is None:
        return trips
    partition = F.col("year") * 12 + F.col("month")
    zones = ledger.latest_months(ledger.read(spark, root)).where("year is not null")
    outside = F.lit(False)
    for bound, after in ((start, True), (end, False)):
        if bound is None:
            continue
        day = F.lit(bound).cast("date")
        if after:
            first = day.cast("timestamp_ntz")
            trips = trips.where(F.col("started_at") >= first)
            outside = outside | (F.col("last_start") < first)
        else:
            next_day = F.date_add(day, 1).cast("timestamp_ntz")
            trips = trips.where(F.col("started_at") < next_day)
            outside = outside | (F.col("first_start") >= next_day)
        if slack_months is not None:
            month = F.year(day) * 12 + F.month(day)
            inside = partition >= month - slack_months if after else partition <= month + slack_months
            trips = trips.where(inside)
    # As many rows as there are months.
    unwanted = [r.n for r in zones.where(outside).select(partition.alias("n")).collect()]
    return trips.where(~partition.isin(*unwanted)) if unwanted else trips


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """The stored dimension, or an empty one before the first load."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in STATIONS.fields])


def read_filtered(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """Rows of a stored table where a column equals a value.

    The predicate reaches the Parquet reader; tables clustered by the column (see
    sinks.LAYOUT) let it skip most row groups.
    """
    return spark.read.parquet(path).where(F.col(column) == value)


def loaded_months(spark: SparkSession, root: str) -> DataFrame:
    """The (year, month) partitions stored under ``root``, from file names alone."""
    empty = spark.createDataFrame([], "year int, month int")
    try:
        files = spark.read.format("binaryFile").load(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    if not {"year", "month"} <= set(files.columns):
        return empty
    return (
        files.select(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"))
        .where("year is not null and month is not null")
        .distinct()
    )
