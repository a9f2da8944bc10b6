"""Raw files: names, headers, reading."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = r"^(\d{4})(\d{2})?\.(csv|parquet)$"


def file_kind(name: Column) -> dict[str, Column]:
    """kind, file_year and file_month of a file name.

    YYYYMM is a monthly file and YYYY a bulk year; anything else is ignored.
    """
    year, month = F.regexp_extract(name, _NAME, 1), F.regexp_extract(name, _NAME, 2)
    kind = F.when(year == "", "ignore").when(month == "", "bulk").otherwise("monthly")
    return {
        "kind": kind,
        "file_year": F.when(year != "", year.try_cast("int")),
        "file_month": F.when(month != "", month.try_cast("int")),
    }


def with_file_kind(files: DataFrame, name: str = "file_name") -> DataFrame:
    return files.select("*", *[c.alias(n) for n, c in file_kind(F.col(name)).items()])


def unit(path: Column) -> Column:
    """What counts as one raw file: the file, or the folder of a table that Spark wrote in parts."""
    return F.regexp_replace(path, r"/part-[^/]*$", "")


def file_name(path: Column) -> Column:
    """The last part of a path; of a partition folder (``raw=202401.csv``) its value."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "^[^=]*=", "")


def read_path() -> Column:
    """The path a row was read from, spelled as listings spell it and not as a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Raw files under a folder with their kind, length and time; contents are not read."""
    try:
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.{csv,parquet}")
            .option("recursiveFileLookup", "true")
            .load(folder)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    own = files.where(~F.col("path").contains("__MACOSX")).groupBy(unit(F.col("path")).alias("path")).agg(
        F.sum("length").alias("length"), F.max("modificationTime").alias("modified")
    )
    return with_file_kind(own.withColumn("file_name", file_name(F.col("path"))))


def in_range(files: DataFrame, first: str | None = None, last: str | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Files whose names lie between two names, both included, some left out."""
    name = F.col("file_name")
    if first is not None:
        files = files.where(name >= first)
    if last is not None:
        files = files.where(name <= last)
    return files.where(~name.isin(*without)) if without else files


@dataclass(frozen=True)
class Batch:
    """Files that share a format and a header and are read together."""

    format: str
    schema: T.StructType
    paths: tuple[str, ...]


def csv_schemas(spark: SparkSession, paths: list[str]) -> dict[str, T.StructType]:
    """The header of each CSV file as text columns, from one job; an empty file has no columns.

    Every file's block is a partition by itself, and its task stops after the first lines
    that it gets, so little more than a header is read of a file of any size.
    """
    if not paths:
        return {}
    alone = spark.newSession()  # only here are small files not read together
    for conf in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"):
        alone.conf.set(conf, str(128 << 20))

    def first(lines: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lines:
            if batch.num_rows and batch.column("at")[0].as_py() == 0:
                yield batch.slice(0, 1).select(["path", "line"])
            return

    lines = alone.read.text(paths).select(unit(read_path()).alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))
    headers = {r.path: r.line for r in lines.mapInArrow(first, "path string, line string").collect()}
    # Paths may be given without the scheme and host that they are read under.
    by_end = {path: next((line for found, line in headers.items() if found.endswith(path)), None) for path in paths if path not in headers}
    found = by_end | headers
    return {path: T.StructType() if found[path] is None else _header(found[path]) for path in paths}


def _header(line: str) -> T.StructType:
    """Column names as the reader makes them: empty ones by place, repeated ones with their place."""
    names = next(csv.reader([line]), [])
    folded = [n.lower() for n in names]
    own = [f"_c{i}" if not n else f"{n}{i}" if folded.count(n.lower()) > 1 else n for i, n in enumerate(names)]
    return T.StructType([T.StructField(n, T.StringType()) for n in own])


def batches(spark: SparkSession, paths: list[str]) -> list[Batch]:
    """Group files by format and header.

    CSV headers are read in one job, Parquet footers a few at a time.  CSV columns are
    all read as text: a type inferred from one month would not hold for the next.
    """
    paths = sorted(paths)
    typed = [p for p in paths if p.endswith(".parquet")]
    schemas = csv_schemas(spark, [p for p in paths if p not in typed])
    with ThreadPoolExecutor(8) as pool:
        schemas |= zip(typed, pool.map(lambda p: spark.read.parquet(p).schema, typed), strict=True)
    groups: dict[tuple[str, str], list[str]] = {}
    for path in paths:
        groups.setdefault(("parquet" if path in typed else "csv", schemas[path].json()), []).append(path)
    return [Batch(kind, schemas[found[0]], tuple(found)) for (kind, _), found in groups.items() if schemas[found[0]].fields]


def read_batch(spark: SparkSession, batch: Batch) -> DataFrame:
    """All rows of a batch with ``_file``, the path of the file each came from."""
    reader = spark.read.schema(batch.schema)
    if batch.format == "csv":
        reader = reader.option("header", "true").option("mode", "PERMISSIVE").option("escape", '"')
    df = getattr(reader, batch.format)(*([list(batch.paths)] if batch.format == "csv" else batch.paths))
    return df.select("*", unit(read_path()).alias("_file"))


def stack(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of any header as one table; columns a file lacks are null.

    A column whose type differs between files becomes text.
    """
    parts = [read_batch(spark, b).drop("_file") for b in batches(spark, paths)]
    if not parts:
        raise ValueError("No files to read")
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for name, kind in part.dtypes:
            kinds.setdefault(name, set()).add(kind)
    drifting = {name for name, seen in kinds.items() if len(seen) > 1}
    whole = None
    for part in parts:
        part = part.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in drifting else F.col(f"`{c}`") for c in part.columns])
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole


def with_numeric_ids(df: DataFrame) -> DataFrame:
    """Station ids of either generation as numbers; rows where one is no number drop out."""
    new, old = ("start_station_id", "end_station_id"), ("Start station number", "End station number")
    ids = [n if n in df.columns else o for n, o in zip(new, old) if n in df.columns or o in df.columns]
    numeric = df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in ids})
    usable = [F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`")) for c in ids]
    for condition in usable:
        numeric = numeric.where(condition)
    return numeric
