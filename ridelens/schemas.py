"""Table schemas and the names raw files use."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _DOUBLE, _INT = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()
_TIME, _DATE = T.TimestampNTZType(), T.DateType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# The canonical ride table, in output order.
CANONICAL = _struct(
    ride_id=_STRING,
    rideable_type=_STRING,
    started_at=_TIME,
    ended_at=_TIME,
    duration_sec=_LONG,
    start_station_id=_LONG,
    start_station_name=_STRING,
    start_lat=_DOUBLE,
    start_lng=_DOUBLE,
    end_station_id=_LONG,
    end_station_name=_STRING,
    end_lat=_DOUBLE,
    end_lng=_DOUBLE,
    bike_number=_STRING,
    member_type=_STRING,
    day=_INT,
    hour=_INT,
    weekday=_INT,
)

# The stored fact table: canonical columns plus its partition columns.
TRIPS = T.StructType([*CANONICAL.fields, T.StructField("year", _INT), T.StructField("month", _INT)])

STATIONS = _struct(
    station_id=_LONG,
    station_name=_STRING,
    lat=_DOUBLE,
    lng=_DOUBLE,
    earliest_seen=_TIME,
    latest_seen=_TIME,
)

# Present on the dimension only after enrichment.
PLACE_COLUMNS = ("city", "state", "zip_code")

# Raw column names of the first file generation.
OLD_NAMES = {
    "Start date": "started_at",
    "End date": "ended_at",
    "Start station": "start_station_name",
    "End station": "end_station_name",
    "Start station number": "start_station_id",
    "End station number": "end_station_id",
    "Bike number": "bike_number",
    "Member type": "member_type",
}

# The one raw name of the second generation that is not canonical.
NEW_NAMES = {"member_casual": "member_type"}

# Filter choices that count as "no filter".
USUAL_MEMBERS = ("member", "casual")
USUAL_RIDEABLES = ("classic_bike", "electric_bike", "docked_bike")
UNKNOWN = "unknown"


def require(df, *columns: str) -> None:
    """Raise unless ``df`` has all ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def require_types(df, schema: T.StructType) -> None:
    """Raise unless every column of ``schema`` is in ``df`` with the same type."""
    require(df, *schema.names)
    wrong = {
        f.name: df.schema[f.name].dataType.simpleString()
        for f in schema.fields
        if df.schema[f.name].dataType != f.dataType
    }
    if wrong:
        raise ValueError(f"Columns of the wrong type: {wrong}")
