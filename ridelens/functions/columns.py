"""Column expressions shared by the plans; all run inside Spark's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridelens.schemas import UNKNOWN


# --- ids, categories -----------------------------------------------------------------
def station_key(c: Column, source_type: str = "string", strict: bool = True) -> Column:
    """A whole-numbered station id as BIGINT, whether it comes as a number or as text, with or without decimals.

    Floats go through BIGINT because their text form turns to E-notation at 1e7.
    A bad id raises, or becomes null with ``strict=False``.
    """
    if source_type in ("double", "float"):
        whole = c.cast("bigint") if strict else c.try_cast("bigint")
        same = whole.cast("double") == c.cast("double")
        bad = F.raise_error(F.concat(F.lit("station id is not whole: "), c.cast("string"))) if strict else F.lit(None)
        return F.when(c.isNull() | same, whole).otherwise(bad.cast("bigint"))
    text = F.regexp_replace(c.cast("string"), r"\.0$", "")
    return text.cast("bigint") if strict else text.try_cast("bigint")


def known(c: Column | str) -> Column:
    """A category with its nulls named."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(UNKNOWN))


def any_null(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


# --- calendar ------------------------------------------------------------------------
def iso_weekday(c: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return (F.weekday(c) + 1).cast("int")


def year_month(c: Column) -> Column:
    return F.date_format(F.to_date(c), "yyyy-MM")


def weekday_label(weekday: Column) -> Column:
    """Mon ... Sun from an ISO weekday number; day 4 of the epoch was a Monday."""
    return F.date_format(F.date_from_unix_date((weekday + 3).cast("int")), "EEE")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


# --- durations -----------------------------------------------------------------------
DAY_SECONDS = 86_400
BUCKET_MINUTES = 5
LAST_BUCKET = 120


def duration_bucket(seconds: Column) -> Column:
    """Start minute of the five-minute bucket; the last one is open-ended."""
    step = BUCKET_MINUTES * 60
    floor = (F.floor(seconds / step) * BUCKET_MINUTES).cast("int")
    return F.least(floor, F.lit(LAST_BUCKET))


def bucket_label(bucket: Column) -> Column:
    return F.when(bucket == LAST_BUCKET, F.lit(f"{LAST_BUCKET}+")).otherwise(
        F.concat_ws("–", bucket.cast("string"), (bucket + BUCKET_MINUTES).cast("string"))
    )


def minutes(seconds: Column, digits: int | None = None) -> Column:
    value = seconds / 60
    return value if digits is None else F.round(value, digits)


# --- labels --------------------------------------------------------------------------
def route_label(start: Column, end: Column) -> Column:
    return F.concat(start, F.lit(" → "), end)


# Display names of metrics.
METRIC_LABELS = {
    "total_checkouts": "Total Checkouts",
    "num_checkouts": "Checkouts",
    "avg_duration_sec": "Avg Duration (min)",
    "net_flow": "Net Flow",
    "trip_count": "Trips",
}


def metric_label(metric: Column) -> Column:
    """Display name of a metric column; others are spelled out in title case."""
    fixed = F.create_map(*[F.lit(x) for pair in METRIC_LABELS.items() for x in pair])
    return F.coalesce(fixed[metric], F.initcap(F.replace(metric, F.lit("_"), F.lit(" "))))


def place_text(lat: Column, lng: Column) -> Column:
    return F.when(
        lat.isNotNull() & lng.isNotNull(), F.format_string("%.6f, %.6f", lat, lng)
    ).otherwise("Coordinates unavailable")


def has_place(lat: Column, lng: Column) -> Column:
    """Coordinates present and not zero."""
    return F.coalesce((lat != 0) & (lng != 0), F.lit(False))


# --- values --------------------------------------------------------------------------
def rescale(value: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """Linear map of [low, high] onto [to_low, to_high]; the midpoint when low = high."""
    span = (value - low) / F.nullif(high - low, F.lit(0))
    return F.when(low == high, F.lit((to_low + to_high) / 2)).otherwise(F.lit(to_low) + span * (to_high - to_low))


def flow_class(mean_net_flow: Column) -> Column:
    return (
        F.when(mean_net_flow > 10, "departure").when(mean_net_flow < -10, "arrival").otherwise("balanced")
    )


def bubble_size(count: Column, smallest: int = 1000) -> Column:
    return F.sqrt(F.greatest(count, F.lit(smallest)).cast("double"))


def share(part: Column, whole: Column) -> Column:
    """Percentage, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


# --- address records -----------------------------------------------------------------
_ADDRESS = (
    "struct<address:struct<city:string,town:string,village:string,county:string,"
    "state:string,postcode:string>>"
)


def address_columns(record: Column) -> dict[str, Column]:
    """city, state and zip_code of a JSON address record.

    The city falls back over smaller and larger places; an empty text counts as
    absent there, but not for state and zip code.
    """
    address = F.from_json(record, _ADDRESS)["address"]
    places = [F.nullif(address[p], F.lit("")) for p in ("city", "town", "village", "county")]
    return {
        "city": F.coalesce(*places, F.lit("Unknown")),
        "state": F.coalesce(address["state"], F.lit("Unknown")),
        "zip_code": F.coalesce(address["postcode"], F.lit("Unknown")),
    }
