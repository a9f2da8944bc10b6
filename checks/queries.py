"""Every query by name, as a function of a session and a folder of test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import stored
from ridelens import standins
from ridelens.functions import columns as fn
from ridelens.plans import build, explorer, filters, flows, ingest, journeys, overview, routes, series, stations, system
from ridelens.sources import calendar, raw, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# The same by their tables, which may also be stored ones.
MAKERS: dict[str, Callable[["Tables"], DataFrame]] = {}

START, END = date(1996, 1, 1), date(2000, 12, 31)


class Tables:
    """The stand-in tables of a folder and the summaries made from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def trips(self) -> DataFrame:
        return standins.trips_li(self.spark, self.folder)

    @property
    def trips_ev(self) -> DataFrame:
        return standins.trips_ev(self.spark, self.folder)

    @property
    def named(self) -> DataFrame:
        return standins.named_trips(self.spark, self.folder)

    @property
    def stations(self) -> DataFrame:
        return standins.stations(self.spark, self.folder, self.trips)

    @property
    def places(self) -> DataFrame:
        """Names and coordinates only."""
        return standins.stations(self.spark, self.folder, places=False)

    @property
    def daily(self) -> DataFrame:
        return flows.station_daily(self.trips, self.places)

    @property
    def detailed(self) -> DataFrame:
        return flows.station_daily_detailed(self.trips, self.places)

    @property
    def hourly(self) -> DataFrame:
        return flows.station_hourly(self.trips, self.places)

    @property
    def routes(self) -> DataFrame:
        return routes.station_routes(self.trips, self.places)

    @property
    def system_daily(self) -> DataFrame:
        return system.system_daily(self.trips)

    @property
    def system_detailed(self) -> DataFrame:
        return system.system_daily_detailed(self.trips)

    @property
    def patterns(self) -> DataFrame:
        return system.trip_patterns(self.trips)

    @property
    def buckets(self) -> DataFrame:
        return system.trip_duration_buckets(self.trips)

    @property
    def loaded(self) -> DataFrame:
        """Months with at least the mean number of rides."""
        months = self.months.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))
        return months.where(F.col("n") >= months.agg(F.avg("n")).scalar()).select("year", "month")

    @property
    def months(self) -> DataFrame:
        return self.trips.select(F.year("started_at").alias("year"), F.month("started_at").alias("month"))


class StoredTables(Tables):
    """As Tables, with the rides and the station summaries read from stored tables."""

    def __init__(self, spark: SparkSession, folder: str, trips_root: str, built: str | None = None):
        super().__init__(spark, folder)
        self.trips_root, self.built = trips_root, built

    @property
    def trips(self) -> DataFrame:
        return tables.read_trips(self.spark, self.trips_root)

    def table(self, name: str, made: DataFrame) -> DataFrame:
        return made if self.built is None else self.spark.read.parquet(build.table_path(self.built, name))

    @property
    def daily(self) -> DataFrame:
        return self.table("station_daily", super().daily)

    @property
    def detailed(self) -> DataFrame:
        return self.table("station_daily_detailed", super().detailed)

    @property
    def hourly(self) -> DataFrame:
        return self.table("station_hourly", super().hourly)

    @property
    def routes(self) -> DataFrame:
        return self.table("station_routes", super().routes)

    @property
    def system_daily(self) -> DataFrame:
        return self.table("system_daily", super().system_daily)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, so that the order of a sum does not show."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str):
    def register(make: Callable[[Tables], DataFrame]):
        MAKERS[name] = make
        QUERIES[name] = lambda spark, folder: rounded(make(Tables(spark, folder)))
        return make

    return register


def _simple(**made: Callable[[Tables], DataFrame]) -> None:
    for name, make in made.items():
        query(name)(make)


# --- summary tables ------------------------------------------------------------------
_simple(
    system_daily=lambda t: t.system_daily,
    system_daily_detailed=lambda t: system.system_daily_detailed(t.trips),
    station_daily=lambda t: t.daily,
    station_daily_one_sided_null=lambda t: flows.station_daily(t.trips, t.places, one_sided_null=True),
    station_daily_returns_on_end=lambda t: flows.station_daily(t.trips, t.places, returns_on="ended_at"),
    station_daily_sample=lambda t: flows.station_daily_sample(t.daily, 20_000),
    station_daily_detailed=lambda t: t.detailed,
    station_hourly=lambda t: t.hourly,
    station_hourly_ev=lambda t: flows.station_hourly(t.trips_ev, t.places),
    station_routes=lambda t: t.routes,
    station_routes_top3=lambda t: routes.station_routes(t.trips, t.places, top_n=3),
    station_routes_ev_top3=lambda t: routes.station_routes(t.trips_ev, t.places, top_n=3),
    routes_by_member_rideable=lambda t: routes.routes_by_member_rideable(t.trips, t.places),
    routes_by_member_rideable_top20=lambda t: routes.routes_by_member_rideable(t.trips, t.places, 20, 2),
    trip_patterns=lambda t: system.trip_patterns(t.trips),
    trip_duration_buckets=lambda t: system.trip_duration_buckets(t.trips),
    time_aggregated=lambda t: system.time_aggregated(t.trips),
    time_level_day=lambda t: system.time_aggregated(t.trips, ("day",)),
    time_level_dow=lambda t: system.time_aggregated(t.trips, ("day_of_week",)),
    time_level_month=lambda t: system.time_aggregated(t.trips, ("month",)),
    time_level_year=lambda t: system.time_aggregated(t.trips, ("year",)),
)

# --- dimension -----------------------------------------------------------------------
_simple(
    station_dimension=lambda t: stations.station_dimension(t.named),
    named_coordinates=lambda t: stations.named_coordinates(t.named),
    latest_coordinates=lambda t: stations.latest_coordinates(stations.named_coordinates(t.named)),
    station_status=lambda t: stations.station_status(t.stations, t.daily).select(
        "station_id", "station_name", "latest_seen", "status"
    ),
    station_profile=lambda t: stations.station_profile(t.stations, t.daily),
    distinct_options=lambda t: filters.options(t.stations, "city"),
)


@query("address_json")
def _(t: Tables) -> DataFrame:
    c, read = F.col, lambda name: t.spark.read.parquet(f"{t.folder}/{name}.parquet")
    customers = (
        read("customer")
        .join(read("nation"), c("c_nationkey") == c("n_nationkey"))
        .join(read("region"), c("n_regionkey") == c("r_regionkey"))
    )
    variant, name = c("c_custkey") % 6, c("n_name")
    address = F.struct(
        F.when(variant == 0, name).when(variant == 1, "").alias("city"),
        F.when(variant == 1, name).alias("town"),
        F.when(variant == 2, name).alias("village"),
        F.when(variant.isin(2, 3), name).alias("county"),
        F.when(variant < 5, c("r_name")).alias("state"),
        F.when(variant < 5, F.lpad(c("c_nationkey").cast("string"), 5, "0")).alias("postcode"),
    )
    return stations.read_addresses(customers.select("c_custkey", F.to_json(F.struct(address.alias("address"))).alias("record")))


@query("enrich_dimension")
def _(t: Tables) -> DataFrame:
    known, third = t.stations, F.col("station_id") % 3
    partly = known.withColumn("city", F.when(third == 0, "Unknown").when(third == 2, F.col("city")))
    addresses = known.select(
        "station_id",
        F.upper("station_name").alias("city"),
        F.lit("Unknown").alias("state"),
        F.col("station_id").cast("string").alias("zip_code"),
    )
    return stations.enrich(partly, addresses)


# --- normalisation and files ---------------------------------------------------------
@query("normalize_ids")
def _(t: Tables) -> DataFrame:
    number = F.col("end_station_id")
    text = (
        F.when(F.col("rideable_type") == "electric_bike", F.concat(number.cast("string"), F.lit(".0")))
        .when(F.col("rideable_type") == "docked_bike", F.concat(F.lit("abc"), number.cast("string")))
        .otherwise(number.cast("string"))
    )
    return t.trips.select(
        "ride_id",
        fn.station_key(text, strict=False).alias("from_text"),
        fn.station_key(number.cast("double"), "double").alias("from_double"),
    )


@query("lenient_timestamps")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("rideable_type") == "docked_bike", "n/a").otherwise(F.col("started_at").cast("string"))
    return ingest.normalize(t.trips.select("ride_id", text.alias("started_at")), t.places).select(
        "ride_id", "started_at", "day", "hour", "weekday"
    )


@query("normalize_old_new_union")
def _(t: Tables) -> DataFrame:
    rides, year = t.named, F.year("started_at")
    text = {c: F.col(c).cast("string") for c in ("started_at", "ended_at", "start_station_id", "end_station_id")}
    old = rides.where(year < 1998).select(
        text["started_at"].alias("Start date"),
        text["ended_at"].alias("End date"),
        text["start_station_id"].alias("Start station number"),
        F.col("start_station_name").alias("Start station"),
        F.col("end_station_id").cast("double").alias("End station number"),
        F.col("end_station_name").alias("End station"),
        F.col("bike_number").alias("Bike number"),
        F.col("member_type").alias("Member type"),
    )
    new = rides.where(year >= 1998).select(
        "ride_id",
        "rideable_type",
        *[text[c].alias(c) for c in ("started_at", "ended_at")],
        "start_station_name",
        F.concat(text["start_station_id"], F.lit(".0")).alias("start_station_id"),
        "end_station_name",
        text["end_station_id"].alias("end_station_id"),
        F.lit("38.5").alias("start_lat"),
        F.lit("-77.5").alias("start_lng"),
        F.lit("38.25").alias("end_lat"),
        F.lit("-77.25").alias("end_lng"),
        F.col("member_type").alias("member_casual"),
    )
    return ingest.normalize(old, t.places).unionByName(ingest.normalize(new, t.places))


_simple(
    busy_months=lambda t: t.loaded,
    missing_months=lambda t: calendar.months_not_loaded(t.loaded),
    unloaded_months=lambda t: calendar.months_not_loaded(t.loaded, t.months.distinct()),
    months_after_latest=lambda t: calendar.months_after_latest(t.loaded, date(2003, 3, 1)),
    # The test rides end before monthly files began: their years are moved by twenty.
    expected_files=lambda t: calendar.expected_files(t.months.select((F.col("year") + 20).alias("year")).distinct()),
    filtered_read=lambda t: tables.read_filtered(t.spark, f"{t.folder}/lineitem.parquet", "l_returnflag", "R"),
)


@query("file_kinds")
def _(t: Tables) -> DataFrame:
    year, month = F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0")
    names = F.array(
        F.concat(year, month, F.lit(".csv")),
        F.concat(year, F.lit(".parquet")),
        F.concat(year, month, F.lit("0.csv")),
        F.concat(F.lit("readme_"), year, month, F.lit(".csv")),
    )
    return raw.with_file_kind(t.months.distinct().select(F.explode(names).alias("file_name")).distinct())


# --- station pages -------------------------------------------------------------------
_simple(
    hourly_grid=lambda t: series.hourly_grid(t.hourly),
    hourly_grid_returns=lambda t: series.hourly_grid(t.hourly, "Returns"),
    hourly_grid_net_flow=lambda t: series.hourly_grid(t.hourly, "Net Flow"),
    grid_range=lambda t: series.grid_range(series.hourly_grid(t.hourly, "Net Flow")),
    pressure_days=lambda t: series.pressure_days(t.daily),
    flow_class=lambda t: series.flow_class(t.daily),
    station_overview=lambda t: explorer.station_overview(t.daily),
    station_totals=lambda t: explorer.station_totals(t.daily),
    station_series=lambda t: series.station_series(t.daily),
    station_series_minutes=lambda t: series.station_series(t.daily, "avg_duration_sec"),
    map_detailed=lambda t: explorer.map_detailed(t.detailed, t.places, START, END),
    map_detailed_weighted=lambda t: explorer.map_detailed(t.detailed, t.places, START, END, weighted=True),
    map_basic=lambda t: explorer.map_basic(t.daily, t.places, START, END),
    map_marker_scale=lambda t: explorer.map_marker_scale(
        explorer.map_basic(t.daily, t.places, START, END), "net_flow"
    ),
    electric_share=lambda t: explorer.electric_share(t.detailed, START, END),
    station_table=lambda t: _station_table(t),
    station_table_filtered=lambda t: _station_table(
        t, statuses=("Active",), min_trips=5, zip_codes=("20001", "20003", "20005", "20007")
    ),
    station_table_summary=lambda t: explorer.station_table_summary(_station_table(t)),
)


def _station_table(t: Tables, **chosen) -> DataFrame:
    table = explorer.station_table(t.stations, t.daily, t.detailed, start=START, end=END, **chosen)
    return explorer.sorted_table(table)


# --- routes --------------------------------------------------------------------------
def _typed(t: Tables) -> DataFrame:
    return routes.routes_by_member_rideable(t.trips, t.places, min_trips=2)


_simple(
    outbound_routes=lambda t: routes.outbound_routes(t.routes),
    inbound_routes=lambda t: routes.inbound_routes(t.routes),
    top_routes=lambda t: routes.top_routes(t.routes),
    top_routes_filtered=lambda t: routes.top_routes(t.routes, _typed(t), members=("member",)),
    route_table=lambda t: routes.route_table(routes.top_routes(t.routes)),
    route_kpis=lambda t: routes.route_kpis(t.routes, routes.top_routes(t.routes)),
    route_map=lambda t: routes.route_map(t.routes),
    system_route_map=lambda t: routes.system_route_map(t.routes),
    route_centroid=lambda t: routes.route_centroid(t.routes),
    route_endpoints=lambda t: routes.route_endpoints(t.routes),
)

# --- system pages --------------------------------------------------------------------


def _summary(t: Tables, level: str) -> DataFrame:
    return overview.time_summary(system.time_aggregated(t.trips), level)


def _with_gaps(t: Tables) -> DataFrame:
    value = F.when(F.col("trips") % 5 != 0, F.col("avg_duration_sec")).when(F.col("trips") % 10 == 0, float("nan"))
    series_ = t.system_daily.select("date", value.alias("y"))
    fitted = series.trend_line(series_, "y")
    return fitted.withColumn("y", F.nanvl("y", F.lit(None).cast("double")))


_simple(
    coverage=lambda t: overview.coverage(t.system_daily),
    system_kpis=lambda t: overview.system_kpis(t.system_daily, START, END),
    trips_by_hour=lambda t: overview.trips_by_hour(t.patterns),
    peak_hours=lambda t: overview.peak_hours(t.patterns),
    trips_by_weekday=lambda t: overview.trips_by_weekday(t.patterns),
    duration_histogram=lambda t: overview.duration_histogram(t.buckets),
    duration_stats=lambda t: overview.duration_stats(t.buckets),
    duration_ranges=lambda t: overview.duration_ranges(t.buckets),
    daily_trend=lambda t: overview.daily_trend(t.system_detailed),
    busiest_quietest=lambda t: overview.busiest_quietest(t.system_detailed),
    by_member=lambda t: overview.by_member(t.system_detailed),
    by_rideable=lambda t: overview.by_rideable(t.system_detailed),
    annual_totals=lambda t: overview.annual_totals(t.system_detailed),
    # The pages' filters: a range of dates or months, kinds of members.
    patterns_filtered=lambda t: overview.trips_by_hour(filters.between_months(t.patterns, START, END)),
    duration_stats_filtered=lambda t: overview.duration_stats(
        filters.of_kinds(filters.between_months(t.buckets, START, END), members=("member",))
    ),
    daily_trend_filtered=lambda t: overview.daily_trend(filters.between_dates(t.system_detailed, START, END)),
    time_summary=lambda t: _summary(t, "day"),
    time_summary_dow=lambda t: _summary(t, "day_of_week"),
    time_kpis=lambda t: overview.time_kpis(_summary(t, "month")),
    time_table=lambda t: overview.time_table(_summary(t, "year")),
    time_insights=lambda t: overview.time_insights(_summary(t, "day")),
    resample_weekly=lambda t: series.resample(t.system_daily, "Weekly"),
    resample_monthly=lambda t: series.resample(t.system_daily, "Monthly"),
    resample_weekly_weighted=lambda t: series.resample(t.system_daily, "Weekly", weighted=True),
    trend_line=lambda t: series.trend_line(t.system_daily.select("date", "trips")),
    trend_line_gaps=_with_gaps,
)

# --- journeys ------------------------------------------------------------------------


def _era_bubbles(t: Tables) -> DataFrame:
    era = F.when(F.year("started_at") < 1998, "before").otherwise("after")
    return journeys.bubbles_by_era(t.named, era, smallest=80)


_simple(
    bike_journeys=lambda t: journeys.bike_journeys(t.trips, t.places),
    station_imbalance=lambda t: journeys.station_imbalance(t.named),
    era_bubbles=_era_bubbles,
)


# --- files and stored tables ---------------------------------------------------------
for _name, _make in stored.MADE.items():
    QUERIES[_name] = lambda spark, folder, make=_make: rounded(make(stored.stored(spark, folder)))
