"""Times the headline work at one scale: one JSON line on stdout.

Follows the way the tables are used: rides are stored by month, summaries are built
from the stored rides, and page queries read the stored summaries.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from checks.queries import MAKERS, StoredTables, Tables
from pyspark.sql import functions as F
from ridelens import sinks
from ridelens.plans.build import ANALYTICS_TABLES, build, build_from
from ridelens.plans.ingest import normalize
from ridelens.session import build_session
from ridelens.sources import ledger

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

FROM_RIDES = (
    "system_daily",
    "system_daily_detailed",
    "station_daily",
    "station_daily_detailed",
    "station_hourly",
    "station_routes",
    "routes_by_member_rideable",
    "trip_patterns",
    "trip_duration_buckets",
    "time_aggregated",
    "station_dimension",
    "bike_journeys",
)
FROM_SUMMARIES = (
    "hourly_grid",
    "pressure_days",
    "map_detailed",
    "station_table",
    "outbound_routes",
    "system_route_map",
    "trend_line",
)


def seconds(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=str(CPUS),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory(prefix="bench-") as out:
        times = run(spark, f"{out}/trips", f"{out}/tables")
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


def one_month_more(spark, trips_root: str, built: str, raw: Tables) -> float:
    """Bringing all tables up to date when one month of the stored rides has been loaded again."""
    kept, stations = f"{trips_root}_kept", f"{trips_root}_stations"
    sinks.write_table(raw.places, stations)
    rides = spark.read.parquet(trips_root)

    def load(part, name: str) -> None:
        marked = part.withColumns({ledger.FILE: F.lit(name), ledger.LOAD: F.lit(name), ledger.UNREAD: F.lit(0)})
        sinks.write_trips(marked.select(*ledger.STORED.names), kept)
        file = spark.createDataFrame([(name, 0, None, "bulk")], "path string, length long, modified timestamp, kind string")
        ledger.append(ledger.entries(spark, kept, name, file, None), kept)

    load(rides, "all")
    build_from(spark, kept, stations, built)
    load(rides.where("year = 1997 and month = 5"), "again")
    return seconds(lambda: build_from(spark, kept, stations, built))


def run(spark, trips_root: str, built: str) -> dict[str, float]:
    raw = Tables(spark, FOLDER)

    def store_rides() -> None:
        rides = normalize(raw.trips, raw.places)
        months = {"year": F.year("started_at"), "month": F.month("started_at")}
        sinks.write_trips(rides.withColumns(months), trips_root)

    def middle(make) -> float:
        """The middle of some runs after a first one, which compiles and warms up."""
        whole = lambda: make().write.format("noop").mode("overwrite").save()
        whole()
        return statistics.median(seconds(whole) for _ in range(RUNS))

    def second(work) -> float:
        work()
        return seconds(work)

    times = {"store_rides": second(store_rides)}
    rides = StoredTables(spark, FOLDER, trips_root)
    for name in FROM_RIDES:
        times[name] = middle(lambda: MAKERS[name](rides))
    times["build_all_tables"] = second(lambda: build(spark, rides.trips, rides.places, built))
    times["build_analytics_tables"] = second(lambda: build(spark, rides.trips, rides.places, f"{built}_some", ANALYTICS_TABLES))
    times["build_one_month_more"] = one_month_more(spark, trips_root, f"{built}_kept", raw)
    summaries = StoredTables(spark, FOLDER, trips_root, built)
    for name in FROM_SUMMARIES:
        times[f"{name}_from_tables"] = middle(lambda: MAKERS[name](summaries))
    return times


if __name__ == "__main__":
    main()
