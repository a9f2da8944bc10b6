"""From raw files to the partitioned ride table and the station dimension."""

from __future__ import annotations

import uuid
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ridelens import sinks
from ridelens.functions import columns as fn
from ridelens.operators.lookup import attach
from ridelens.plans import upkeep
from ridelens.plans.stations import merge_dimension, station_dimension, station_sightings
from ridelens.schemas import CANONICAL, NEW_NAMES, OLD_NAMES, require
from ridelens.sources import ledger, raw
from ridelens.sources.tables import loaded_months, read_stations


# Layouts of times in text files besides ISO's.
TIME_LAYOUTS = ("yyyy/M/d H:mm[:ss]", "M/d/yyyy H:mm[:ss]")


# --- one raw table to canonical form --------------------------------------------------
def _as_time(df: DataFrame, name: str) -> Column:
    """Text is read by the first of TIME_LAYOUTS that fits, else null; typed times are taken as they are."""
    if dict(df.dtypes)[name] == "string":
        text = F.col(name)
        others = [F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz") for layout in TIME_LAYOUTS]
        return F.coalesce(text.try_cast("timestamp_ntz"), *others)
    return F.col(name).cast("timestamp_ntz")


def _unread(df: DataFrame, strict: bool) -> Column:
    """Bits for values that are there as text and cannot be read: times, and ids where these may become null."""
    kinds, bits = dict(df.dtypes), F.lit(0)
    for bit, name in enumerate(ledger.CHECKED):
        if kinds.get(name) != "string" or (strict and name.endswith("_id")):
            continue
        read = _as_time(df, name) if name.endswith("_at") else fn.station_key(F.col(name), "string", strict=False)
        bits = bits + F.when((F.trim(name) != "") & read.isNull(), 1 << bit).otherwise(0)
    return bits.alias(ledger.UNREAD)


def normalize(
    df: DataFrame, stations: DataFrame, strict: bool = True, fold_case: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """A raw table of either generation as canonical rides, plus the columns in ``keep``.

    Coordinates come from the file where it has such columns and else from the
    dimension.  ``strict`` raises on a bad station id; otherwise it becomes null.
    ``fold_case`` writes member types in lower case.  ``_unread`` in ``keep`` adds which
    times and ids were there and could not be read.
    """
    df = df.withColumnsRenamed({old: new for old, new in {**OLD_NAMES, **NEW_NAMES}.items() if old in df.columns})
    require(df, "started_at")
    kinds = dict(df.dtypes)
    if ledger.UNREAD in keep:
        df = df.select("*", _unread(df, strict))
    df = df.withColumns({c: _as_time(df, c) for c in ("started_at", "ended_at") if c in kinds})
    df = df.withColumns(
        {
            "day": F.dayofmonth("started_at"),
            "hour": F.hour("started_at"),
            "weekday": fn.iso_weekday(F.col("started_at")),
        }
    )
    if "duration_sec" not in kinds and "ended_at" in kinds:
        df = df.withColumn("duration_sec", fn.seconds_between(F.col("started_at"), F.col("ended_at")))
    for end in ("start", "end"):
        key = f"{end}_station_id"
        if key not in kinds:
            continue
        df = df.withColumn(key, fn.station_key(F.col(key), kinds[key], strict))
        lacking = {f"{end}_{c}": c for c in ("lat", "lng") if f"{end}_{c}" not in kinds}
        if lacking:
            df = attach(df, stations, key, **lacking)
    if fold_case and "member_type" in kinds:
        df = df.withColumn("member_type", F.lower("member_type"))
    return df.select(*[_typed(df, field) for field in CANONICAL.fields], *keep)


def _typed(df: DataFrame, field) -> Column:
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType).alias(field.name)
    if df.schema[field.name].dataType == field.dataType:
        return F.col(field.name)
    text = dict(df.dtypes)[field.name] == "string"
    return (F.col(field.name).try_cast if text else F.col(field.name).cast)(field.dataType).alias(field.name)


# --- files to the ride table ----------------------------------------------------------
def pick_files(files: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """Files to load: known names, not yet loaded months, one file per name stem.

    Of several files of a stem, in other folders or formats, the last in the order of
    full paths is taken; ``passed_over`` counts the others.
    """
    wanted = files.where("kind != 'ignore'")
    if loaded is not None:
        months = loaded.select(F.col("year").alias("file_year"), F.col("month").alias("file_month"))
        wanted = wanted.join(months, ["file_year", "file_month"], "left_anti")
    about = [c for c in ("length", "modified") if c in files.columns]
    return wanted.groupBy("kind", "file_year", "file_month").agg(
        F.max("path").alias("path"),
        *[F.max_by(c, "path").alias(c) for c in about],
        (F.count(F.lit(1)) - 1).alias("passed_over"),
    )


def files_to_load(files: DataFrame, loaded: DataFrame, known: DataFrame, changed: bool = False) -> DataFrame:
    """``pick_files``, less the bulk years that were loaded, plus changed files if asked for.

    ``known`` are the files of the ledger. A bulk year has no month of its own to be
    found loaded, so without the ledger each load would read it again. A file has changed
    if its length or time is not the one in the ledger.
    """
    first = pick_files(files, loaded).join(known.select("path"), "path", "left_anti")
    if not changed:
        return first
    was = known.select("path", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    differs = ~(F.col("length").eqNullSafe(F.col("_length")) & F.col("modified").eqNullSafe(F.col("_modified")))
    again = pick_files(files).join(was, "path").where(differs).select(*first.columns)
    return first.unionByName(again).dropDuplicates(["path"])


def _placed(df: DataFrame) -> DataFrame:
    """Partition columns: a monthly file's month, a bulk file's rows by their start."""
    kind = raw.file_kind(raw.file_name(F.col("_file")))
    bulk = kind["kind"] == "bulk"
    return df.select(
        *CANONICAL.names,
        ledger.FILE,
        ledger.UNREAD,
        bulk.alias("_bulk"),
        F.when(bulk, F.year("started_at")).otherwise(kind["file_year"]).alias("year"),
        F.when(bulk, F.month("started_at")).otherwise(kind["file_month"]).alias("month"),
    )


def load_trips(
    spark: SparkSession,
    raw_folder: str,
    trips_root: str,
    stations: DataFrame,
    missing_only: bool = True,
    strict: bool | None = None,
    compact: bool = True,
    changed: bool = False,
) -> list[Row]:
    """Load raw files into the ride table; returns the new entries of its ledger, none if there was nothing to load.

    Files are read a batch of equal headers at a time and written in one job.  Rows of
    a bulk year are skipped where their month is loaded already or has a monthly file.
    A file that is in the ledger is not opened again, unless it has changed and
    ``changed`` asks for such files: then it replaces the months that it filled.  Without
    ``missing_only`` all files are loaded.  ``strict`` on ids defaults to Parquet files
    only, whose columns are typed.  Entries tell of each file and month how many rides,
    between which starts, and how many times and ids could not be read.
    """
    # Month and file lists, and the ledger, grow with the calendar, not with the rides.
    files = raw.list_files(spark, raw_folder)
    loaded = loaded_months(spark, trips_root) if missing_only else None
    entered = ledger.read(spark, trips_root)
    to_load = files_to_load(files, loaded, ledger.latest_files(entered), changed) if missing_only else pick_files(files)
    picked = to_load.collect()
    if not picked:
        return []
    for file in picked:
        if file.passed_over:
            warnings.warn(f"{file.path} taken; {file.passed_over} more of this month or year passed over", stacklevel=2)
    settled = {(r.file_year, r.file_month) for r in picked if r.kind == "monthly"}
    if loaded is not None:
        filled_by = {(r.year, r.month): r.path for r in _last_filled(entered).collect()}
        paths = {r.path for r in picked}
        settled |= {(r.year, r.month) for r in loaded.collect() if filled_by.get((r.year, r.month)) not in paths}

    parts = []
    for batch in raw.batches(spark, [r.path for r in picked]):
        exact = batch.format == "parquet" if strict is None else strict
        keep = (ledger.FILE, ledger.UNREAD)
        parts.append(_placed(normalize(raw.read_batch(spark, batch), stations, exact, keep=keep)))
    rows = reduce(DataFrame.unionByName, parts)
    if any(r.kind == "bulk" for r in picked):
        done = spark.createDataFrame(sorted(settled), "year int, month int").withColumn("_done", F.lit(True))
        rows = rows.join(done, ["year", "month"], "left").where("not _bulk or _done is null")
    load = uuid.uuid4().hex
    rows = rows.withColumn(ledger.LOAD, F.lit(load)).select(*ledger.STORED.names)
    sinks.write_trips(rows, trips_root, compact)

    opened = spark.createDataFrame([(r.path, r.length, r.modified, r.kind) for r in picked], "path string, length long, modified timestamp, kind string")
    monthly = all(r.kind == "monthly" for r in picked)
    months = [(r.file_year, r.file_month) for r in picked] if monthly else None
    new = ledger.entries(spark, trips_root, load, opened, months).collect()
    ledger.append(spark.createDataFrame(new, ledger.SCHEMA), trips_root)
    return new


def _last_filled(entered: DataFrame) -> DataFrame:
    """year, month and path of the file that last filled a month."""
    place = F.row_number().over(Window.partitionBy("year", "month").orderBy(F.desc("loaded_at"), F.desc("load")))
    return entered.where("rides > 0 and year is not null").withColumn("_place", place).where("_place = 1").select("year", "month", "path")


def refresh(
    spark: SparkSession, raw_folder: str, trips_root: str, stations_path: str, missing_only: bool = True, **options
) -> list[Row]:
    """Load raw files, then bring the station dimension up to date; returns the new entries of the ledger.

    Sightings of stations are kept by month, and only months that were loaded since are
    read again. What enrichment has found stays with its station.
    """
    known = read_stations(spark, stations_path)
    new = load_trips(spark, raw_folder, trips_root, known, missing_only, **options)
    sightings = f"{stations_path.rstrip('/')}_sightings"
    if upkeep.bring_up_to_date(spark, trips_root, {sightings: station_sightings}):
        upkeep.replace_table(merge_dimension(known, station_dimension(upkeep.read_cube(spark, sightings))), stations_path)
    return new


def convert_raw(spark: SparkSession, paths: list[str], target: str) -> None:
    """Raw CSV files of one period, whatever their headers, as one Parquet table."""
    raw.with_numeric_ids(raw.stack(spark, paths)).write.mode("overwrite").parquet(target)
