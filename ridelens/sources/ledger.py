"""What was loaded into the ride table: a row for each file, load and month it filled.

The ledger lies in the ride table's folder, where readers of the table do not see it. It
grows with the calendar, not with the rides. From it come which files to read again,
which months hold which range of start times, and how many values could not be read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelens.schemas import TRIPS

# Columns stored with each ride and read by nothing but the ledger.
FILE, LOAD, UNREAD = "_file", "_load", "_unread"
STORED = T.StructType([*TRIPS.fields, T.StructField(FILE, T.StringType()), T.StructField(LOAD, T.StringType()), T.StructField(UNREAD, T.IntegerType())])

# Bits of UNREAD: a value that was there and could not be read.
CHECKED = ("started_at", "ended_at", "start_station_id", "end_station_id")

SCHEMA = (
    "load string, loaded_at timestamp, path string, length long, modified timestamp, kind string, year int, month int, "
    "rides long, first_start timestamp_ntz, last_start timestamp_ntz, " + ", ".join(f"unread_{c} long" for c in CHECKED)
)


def path_of(trips_root: str) -> str:
    return f"{trips_root.rstrip('/')}/_ledger"


def read(spark: SparkSession, trips_root: str) -> DataFrame:
    """All entries, or none before the first load."""
    try:
        return spark.read.schema(SCHEMA).parquet(path_of(trips_root))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def entries(spark: SparkSession, trips_root: str, load: str, files: DataFrame, months: list[tuple[int, int]] | None) -> DataFrame:
    """The entries of one load, from the rides it has just stored and the files it read.

    Only the given months are looked at (None: all, as it is not known which months a
    bulk year fills), and of these only a few narrow columns. A file that filled nothing
    has one entry without a month.
    """
    unread = [
        F.count_if(F.col(UNREAD).bitwiseAND(1 << bit) != 0).alias(f"unread_{name}") for bit, name in enumerate(CHECKED)
    ]
    stored = spark.read.schema(STORED).parquet(trips_root)
    if months is not None:
        stored = stored.where((F.col("year") * 12 + F.col("month")).isin(*[12 * year + month for year, month in months]))
    filled = (
        stored.where(F.col(LOAD) == load)
        .groupBy(F.col(FILE).alias("path"), "year", "month")
        .agg(
            F.count(F.lit(1)).alias("rides"),
            F.min("started_at").alias("first_start"),
            F.max("started_at").alias("last_start"),
            *unread,
        )
    )
    joined = files.select("path", "length", "modified", "kind").join(filled, "path", "left")
    return joined.select(
        F.lit(load).alias("load"), F.current_timestamp().alias("loaded_at"), "path", "length", "modified", "kind", "year", "month",
        F.coalesce("rides", F.lit(0)).alias("rides"), "first_start", "last_start", *(F.coalesce(f"unread_{c}", F.lit(0)).alias(f"unread_{c}") for c in CHECKED),
    )


def append(entered: DataFrame, trips_root: str) -> None:
    entered.coalesce(1).write.mode("append").parquet(path_of(trips_root))


def latest_files(entered: DataFrame) -> DataFrame:
    """path, length and modified of each file as it was when last loaded."""
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("loaded_at"), F.desc("load")))
    return entered.withColumn("_place", place).where("_place = 1").select("path", "length", "modified")


def latest_months(entered: DataFrame) -> DataFrame:
    """year, month, load, first_start, last_start and rides of each stored month, as its last load left it."""
    whole = entered.where("rides > 0").groupBy("year", "month", "load", "loaded_at").agg(
        F.min("first_start").alias("first_start"), F.max("last_start").alias("last_start"), F.sum("rides").alias("rides")
    )
    place = F.row_number().over(Window.partitionBy("year", "month").orderBy(F.desc("loaded_at"), F.desc("load")))
    return whole.withColumn("_place", place).where("_place = 1").drop("_place", "loaded_at")
