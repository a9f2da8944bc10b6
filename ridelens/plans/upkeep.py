"""Mergeable tables (cubes) kept by month of the ride table, so that only months loaded since are read again."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ridelens import sinks
from ridelens.schemas import TRIPS
from ridelens.sources import ledger
from ridelens.sources.tables import loaded_months

MONTH = ("year", "month")
_BUILT = "year int, month int, load string, built_at timestamp"

# Measures rides by some keys and, besides them, by the columns named in the second argument.
Cube = Callable[[DataFrame, tuple[str, ...]], DataFrame]


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """A stored cube, without its month; rows that only mark a month as built have no rides."""
    return spark.read.parquet(path).where("n > 0").drop(*MONTH)


def write_cube(cube: DataFrame, path: str) -> None:
    """Replaces the whole cube; what was known of its months goes with it."""
    cube.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*MONTH).parquet(path)


def _built(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_BUILT).parquet(f"{path}/_built")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _BUILT)


def stale_months(spark: SparkSession, trips_root: str, path: str) -> list[Row]:
    """year, month and load of the stored months that a cube lacks, or has from an earlier load.

    Months that the ledger does not know have no load, and count as changed each time.
    Unreadable start times are a month without year and month. One row a month.
    """
    loads = ledger.latest_months(ledger.read(spark, trips_root)).select(*MONTH, "load")
    months = loaded_months(spark, trips_root).join(loads, list(MONTH), "left").unionByName(loads.where("year is null"))
    place = F.row_number().over(Window.partitionBy(*MONTH).orderBy(F.desc("built_at")))
    built = _built(spark, path).withColumn("_place", place).where("_place = 1").select(*MONTH, "load")
    return months.exceptAll(built.where("load is not null")).collect()


def _of_months(trips: DataFrame, months: list[Row]) -> DataFrame:
    number = F.col("year") * 12 + F.col("month")
    dated = number.isin(*[r.year * 12 + r.month for r in months if r.year is not None])
    return trips.where(dated | number.isNull() if any(r.year is None for r in months) else dated)


def bring_up_to_date(spark: SparkSession, trips_root: str, cubes: dict[str, Cube], at_once: int = 4) -> dict[str, list[Row]]:
    """Builds the stale months of cubes, by path, from their rides alone; returns what was built, without cubes that were not stale.

    Each cube's months are written in one job that replaces these partitions. A month
    without rows for a cube gets a row that marks it, which also replaces what was there.
    What was built is noted after the write: a run that ends between builds them again.
    """
    with ThreadPoolExecutor(at_once) as pool:
        stale = dict(zip(cubes, pool.map(lambda path: stale_months(spark, trips_root, path), cubes), strict=True))

        def build(path: str) -> None:
            months = stale[path]
            trips = _of_months(spark.read.schema(TRIPS).parquet(trips_root), months)
            cube = cubes[path](trips, MONTH)
            noted = spark.createDataFrame([tuple(r) for r in months], "year int, month int, load string")
            marks = noted.select(
                *[
                    F.col(f.name) if f.name in MONTH else F.lit(0 if f.name == "n" else None).cast(f.dataType).alias(f.name)
                    for f in cube.schema
                ]
            )
            whole = cube.unionByName(marks).hint("rebalance", *MONTH)
            whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*MONTH).parquet(path)
            noted.coalesce(1).withColumn("built_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/_built")

        built = {path: months for path, months in stale.items() if months}
        list(pool.map(build, built))
    return built


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces a table that ``df`` itself may read: it is written beside it first, and then from there."""
    spark, staged = df.sparkSession, f"{path.rstrip('/')}_next"
    sinks.write_table(df, staged)
    sinks.write_table(spark.read.parquet(staged), path)
