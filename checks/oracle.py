"""The same queries as plain SQL, written from the definitions and not from the plans."""

from __future__ import annotations

import re

# Named parts; a query pulls in those it mentions, directly or through another part.
_PARTS: dict[str, str] = {}

_PARTS["t"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CAST(l_quantity AS BIGINT), CAST(round(l_discount * 100) AS BIGINT)) AS ride_id,
       CASE l_orderkey % 4 WHEN 0 THEN 'classic_bike' WHEN 1 THEN 'electric_bike' WHEN 2 THEN 'docked_bike' END AS rideable_type,
       l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS started_at,
       l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER))
         + to_seconds(CAST(l_quantity AS BIGINT) * l_linenumber * 60 - 240
                      + CASE WHEN l_tax > 0.075 AND l_linenumber = 7 THEN 86400 ELSE 0 END) AS ended_at,
       CAST(CAST(l_quantity AS BIGINT) * l_linenumber * 60 - 240
            + CASE WHEN l_tax > 0.075 AND l_linenumber = 7 THEN 86400 ELSE 0 END AS BIGINT) AS duration_sec,
       CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL ELSE 31000 + l_suppkey END AS start_station_id,
       CASE WHEN l_linenumber = 6 AND l_returnflag = 'R' THEN NULL ELSE 31000 + l_partkey % 100 END AS end_station_id,
       CASE WHEN l_linenumber <= 3 THEN 'W' || lpad(CAST(l_partkey % 500 AS VARCHAR), 5, '0') END AS bike_number,
       CASE l_returnflag WHEN 'A' THEN 'member' WHEN 'R' THEN 'casual' END AS member_type
FROM lineitem"""

_PARTS["e"] = r"""
SELECT CAST(event_id AS VARCHAR) AS ride_id,
       CASE user_id % 4 WHEN 0 THEN 'classic_bike' WHEN 1 THEN 'electric_bike' WHEN 2 THEN 'docked_bike' END AS rideable_type,
       ts AS started_at, ts + to_seconds(d) AS ended_at, d AS duration_sec,
       CASE WHEN k <> 99 THEN 31000 + k % 10 END AS start_station_id,
       31000 + user_id % 10 AS end_station_id,
       CASE WHEN event_id % 2 = 0 THEN 'W' || lpad(CAST(user_id AS VARCHAR), 5, '0') END AS bike_number,
       CASE WHEN event_type IN ('click', 'purchase') THEN 'member' WHEN event_type IN ('view', 'error') THEN 'casual' END AS member_type
FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k,
             CASE WHEN event_type = 'error' THEN -CAST(floor(value * 60) AS BIGINT) ELSE CAST(floor(value * 60) AS BIGINT) END AS d
      FROM events)"""

_PARTS["seen"] = """
SELECT station_id, min(started_at) AS earliest_seen, max(started_at) AS latest_seen
FROM (SELECT start_station_id AS station_id, started_at FROM t UNION ALL SELECT end_station_id, started_at FROM t)
WHERE station_id IS NOT NULL GROUP BY station_id"""

_PARTS["s"] = """
SELECT 31000 + s_suppkey AS station_id, s_name AS station_name,
       CASE WHEN s_suppkey % 17 <> 16 THEN CAST(38.8 AS DOUBLE) + (s_suppkey % 50) * CAST(0.004 AS DOUBLE) END AS lat,
       CASE WHEN s_suppkey % 17 <> 16 THEN CAST(-77.2 AS DOUBLE) + (s_suppkey % 40) * CAST(0.005 AS DOUBLE) END AS lng,
       earliest_seen, latest_seen, n_name AS city, r_name AS state,
       '2' || lpad(CAST(s_nationkey % 10 AS VARCHAR), 4, '0') AS zip_code
FROM supplier LEFT JOIN seen ON seen.station_id = 31000 + s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE s_suppkey % 25 <> 24"""

_PARTS["nt"] = """
SELECT t.*, a.lat AS start_lat, a.lng AS start_lng, b.lat AS end_lat, b.lng AS end_lng,
       CASE WHEN year(started_at) < 1998 THEN a.station_name || ' (old)' ELSE a.station_name END AS start_station_name,
       CASE WHEN year(started_at) < 1998 THEN b.station_name || ' (old)' ELSE b.station_name END AS end_station_name
FROM t LEFT JOIN s a ON a.station_id = start_station_id LEFT JOIN s b ON b.station_id = end_station_id"""

_PARTS["k"] = """
SELECT * REPLACE (coalesce(member_type, 'unknown') AS member_type, coalesce(rideable_type, 'unknown') AS rideable_type) FROM t"""

_PARTS["system_daily"] = """
SELECT CAST(started_at AS DATE) AS date, count(*) AS trips, avg(duration_sec) AS avg_duration_sec
FROM t WHERE duration_sec > 0 GROUP BY 1"""

_PARTS["system_daily_detailed"] = """
SELECT CAST(started_at AS DATE) AS date, member_type, rideable_type, count(*) AS trips, avg(duration_sec) AS avg_duration_sec
FROM k WHERE duration_sec > 0 GROUP BY ALL"""


def _daily(returned: str = "started_at", net: str = "coalesce(num_checkouts, 0) - coalesce(num_returns, 0)") -> str:
    return f"""
SELECT date, station_id, station_name, lat, lng, coalesce(num_checkouts, 0) AS num_checkouts, avg_duration_sec,
       distinct_bikes_out, coalesce(num_returns, 0) AS num_returns, {net} AS net_flow
FROM (SELECT start_station_id AS station_id, CAST(started_at AS DATE) AS date, count(*) AS num_checkouts,
             avg(duration_sec) AS avg_duration_sec,
             count(DISTINCT bike_number) + max(CASE WHEN bike_number IS NULL THEN 1 ELSE 0 END) AS distinct_bikes_out
      FROM t WHERE duration_sec > 0 GROUP BY 1, 2)
FULL JOIN (SELECT end_station_id AS station_id, CAST({returned} AS DATE) AS date, count(*) AS num_returns FROM t GROUP BY 1, 2)
USING (station_id, date)
LEFT JOIN s USING (station_id)"""


_PARTS["station_daily"] = _daily()

_PARTS["station_daily_detailed"] = """
SELECT date, station_id, station_name, lat, lng, member_type, rideable_type,
       coalesce(num_checkouts, 0) AS num_checkouts, coalesce(num_returns, 0) AS num_returns,
       avg_duration_checkout_sec, avg_duration_return_sec, distinct_bikes_out,
       coalesce(num_checkouts, 0) - coalesce(num_returns, 0) AS net_flow
FROM (SELECT start_station_id AS station_id, CAST(started_at AS DATE) AS date, member_type, rideable_type,
             count(*) AS num_checkouts, avg(duration_sec) AS avg_duration_checkout_sec,
             count(DISTINCT bike_number) + max(CASE WHEN bike_number IS NULL THEN 1 ELSE 0 END) AS distinct_bikes_out
      FROM k WHERE duration_sec > 0 GROUP BY ALL)
FULL JOIN (SELECT end_station_id AS station_id, CAST(started_at AS DATE) AS date, member_type, rideable_type,
                  count(*) AS num_returns, avg(duration_sec) AS avg_duration_return_sec
           FROM k WHERE duration_sec > 0 GROUP BY ALL)
USING (station_id, date, member_type, rideable_type)
LEFT JOIN s USING (station_id)"""


def _hourly(rides: str) -> str:
    return f"""
SELECT date, hour, station_id, station_name, lat, lng, coalesce(num_checkouts, 0) AS num_checkouts,
       coalesce(num_returns, 0) AS num_returns,
       CAST(coalesce(num_checkouts, 0) - coalesce(num_returns, 0) AS INTEGER) AS net_flow
FROM (SELECT start_station_id AS station_id, CAST(started_at AS DATE) AS date, CAST(hour(started_at) AS INTEGER) AS hour,
             count(*) AS num_checkouts FROM {rides} GROUP BY ALL)
FULL JOIN (SELECT end_station_id AS station_id, CAST(ended_at AS DATE) AS date, CAST(hour(ended_at) AS INTEGER) AS hour,
                  count(*) AS num_returns FROM {rides} GROUP BY ALL)
USING (station_id, date, hour)
LEFT JOIN s USING (station_id)"""


_PARTS["station_hourly"] = _hourly("t")
_PARTS["station_hourly_ev"] = _hourly("e")


def _average_rank(over: str) -> str:
    return (
        f"rank() OVER (PARTITION BY {over} ORDER BY trip_count DESC) "
        f"+ (count(*) OVER (PARTITION BY {over}, trip_count) - 1) / 2.0"
    )


def _routes(rides: str, top_n: int, min_trips: int = 10) -> str:
    return f"""
SELECT start_station_id, a.station_name AS start_station_name, a.lat AS start_lat, a.lng AS start_lng,
       end_station_id, b.station_name AS end_station_name, b.lat AS end_lat, b.lng AS end_lng, trip_count, avg_duration_sec
FROM (SELECT *, {_average_rank("start_station_id")} AS r_out, {_average_rank("end_station_id")} AS r_in
      FROM (SELECT start_station_id, end_station_id, count(*) AS trip_count, avg(duration_sec) AS avg_duration_sec
            FROM {rides} WHERE start_station_id <> end_station_id GROUP BY 1, 2 HAVING count(*) >= {min_trips})) r
LEFT JOIN s a ON a.station_id = start_station_id LEFT JOIN s b ON b.station_id = end_station_id
WHERE r_out <= {top_n} OR r_in <= {top_n}"""


_PARTS["station_routes"] = _routes("t", 20)


def _typed_routes(top_n: int, min_trips: int) -> str:
    return f"""
SELECT a.station_name AS start_station_name, b.station_name AS end_station_name, member_type, rideable_type,
       trip_count, avg_duration_sec
FROM (SELECT *, {_average_rank("member_type, rideable_type")} AS r
      FROM (SELECT start_station_id, end_station_id, member_type, rideable_type, count(*) AS trip_count,
                   avg(duration_sec) AS avg_duration_sec
            FROM k WHERE duration_sec > 0 AND start_station_id <> end_station_id
            GROUP BY ALL HAVING count(*) >= {min_trips})) r
LEFT JOIN s a ON a.station_id = start_station_id LEFT JOIN s b ON b.station_id = end_station_id
WHERE r <= {top_n}"""


_PARTS["typed_routes"] = _typed_routes(100, 2)

_PARTS["trip_patterns"] = """
SELECT strftime(started_at, '%Y-%m') AS year_month, CAST(hour(started_at) AS INTEGER) AS hour,
       CAST(isodow(started_at) AS INTEGER) AS weekday, member_type, rideable_type,
       count(*) AS trip_count, avg(duration_sec) AS avg_duration_sec
FROM k WHERE duration_sec > 0 GROUP BY ALL"""

_PARTS["trip_duration_buckets"] = """
SELECT strftime(started_at, '%Y-%m') AS year_month,
       CAST(CASE WHEN duration_sec / 60.0 >= 120 THEN 120 ELSE floor(duration_sec / 60.0 / 5) * 5 END AS INTEGER) AS bucket_start_min,
       member_type, rideable_type, count(*) AS trip_count
FROM k WHERE duration_sec > 0 AND duration_sec < 86400 GROUP BY ALL"""

_LEVELS = {
    "day": ("CAST(CAST(started_at AS DATE) AS VARCHAR)", "date_diff('day', DATE '1970-01-01', CAST(started_at AS DATE))"),
    "day_of_week": ("dayname(started_at)", "isodow(started_at)"),
    "month": ("monthname(started_at)", "month(started_at)"),
    "year": ("CAST(year(started_at) AS VARCHAR)", "year(started_at)"),
}
_PARTS["time_aggregated"] = " UNION ALL ".join(
    f"""
SELECT '{level}' AS agg_level, {value} AS agg_value, CAST({key} AS INTEGER) AS agg_sort_key, member_type, rideable_type,
       count(*) AS total_checkouts, count(*) AS total_returns, 0 AS net_flow, count(*) AS total_trips,
       avg(duration_sec) AS avg_duration_sec
FROM k WHERE duration_sec > 0 GROUP BY {value}, {key}, member_type, rideable_type"""
    for level, (value, key) in _LEVELS.items()
)

_PARTS["months"] = "SELECT year(started_at) AS year, month(started_at) AS month, count(*) AS n FROM t GROUP BY ALL"
_PARTS["loaded"] = "SELECT year, month FROM months WHERE n >= (SELECT avg(n) FROM months)"


def oracle(body: str, digits: tuple[str, ...] = ()) -> str:
    """A query with the parts it needs; ``digits`` are rounded to 6 places."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in _PARTS:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(_PARTS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    # A part only reads parts defined before it, which the order of definition gives.
    ordered = [name for name in _PARTS if name in needed]
    ctes = ",\n".join(f"{name} AS ({_PARTS[name]})" for name in ordered)
    if digits:
        rounded = ", ".join(f"round({c}, 6) AS {c}" for c in digits)
        body = f"SELECT * REPLACE ({rounded}) FROM ({body})"
    return (f"WITH {ctes}\n" if ctes else "") + body


_USUAL = (
    "member_type IN ('member', 'casual') AND rideable_type IN ('classic_bike', 'electric_bike', 'docked_bike')"
)
_DUR = ("avg_duration_sec",)
_STATION = ("lat", "lng")
_ENDS = ("start_lat", "start_lng", "end_lat", "end_lng")

ORACLES: dict[str, str] = {}


def _add(key: str, body: str, *digits: str) -> None:
    ORACLES[key] = oracle(body, digits)


# --- summary tables ------------------------------------------------------------------
_add("system_daily", "SELECT * FROM system_daily", *_DUR)
_add("system_daily_detailed", "SELECT * FROM system_daily_detailed", *_DUR)
_add("station_daily", "SELECT * FROM station_daily", *_STATION, *_DUR)
_add(
    "station_daily_one_sided_null",
    _daily(net="num_checkouts - num_returns"),
    *_STATION,
    *_DUR,
)
_add("station_daily_returns_on_end", _daily("ended_at"), *_STATION, *_DUR)
_add(
    "station_daily_sample",
    """SELECT * FROM station_daily
ORDER BY md5(concat_ws('|', coalesce(CAST(date AS VARCHAR), ''), coalesce(CAST(station_id AS VARCHAR), ''),
                       CAST(num_checkouts AS VARCHAR), CAST(num_returns AS VARCHAR), '42'))
LIMIT 20000""",
    *_STATION,
    *_DUR,
)
_add(
    "station_daily_detailed",
    "SELECT * FROM station_daily_detailed",
    *_STATION,
    "avg_duration_checkout_sec",
    "avg_duration_return_sec",
)
_add("station_hourly", "SELECT * FROM station_hourly", *_STATION)
_add("station_hourly_ev", "SELECT * FROM station_hourly_ev", *_STATION)
_add("station_routes", "SELECT * FROM station_routes", *_ENDS, *_DUR)
_add("station_routes_top3", _routes("t", 3), *_ENDS, *_DUR)
_add("station_routes_ev_top3", _routes("e", 3), *_ENDS, *_DUR)
_add("routes_by_member_rideable", _typed_routes(100, 5), *_DUR)
_add("routes_by_member_rideable_top20", _typed_routes(20, 2), *_DUR)
_add("trip_patterns", "SELECT * FROM trip_patterns", *_DUR)
_add("trip_duration_buckets", "SELECT * FROM trip_duration_buckets")
_add("time_aggregated", "SELECT * FROM time_aggregated", *_DUR)
for _level in _LEVELS:
    _short = {"day_of_week": "dow"}.get(_level, _level)
    _add(f"time_level_{_short}", f"SELECT * FROM time_aggregated WHERE agg_level = '{_level}'", *_DUR)

# --- dimension -----------------------------------------------------------------------
_DIMENSION = """SELECT station_id, station_name, lat, lng, earliest_seen, latest_seen FROM (
SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY latest_seen DESC NULLS LAST, station_name NULLS FIRST) AS r FROM (
SELECT station_id, station_name, avg(lat) AS lat, avg(lng) AS lng, min(seen_at) AS earliest_seen, max(seen_at) AS latest_seen FROM (
SELECT start_station_id AS station_id, start_station_name AS station_name, start_lat AS lat, start_lng AS lng, started_at AS seen_at FROM nt
UNION ALL SELECT end_station_id, end_station_name, end_lat, end_lng, started_at FROM nt)
WHERE station_id IS NOT NULL GROUP BY 1, 2)) WHERE r = 1"""
_add("station_dimension", _DIMENSION, *_STATION)
_COORD = """SELECT start_station_id, start_station_name, avg(start_lat) AS start_lat, avg(start_lng) AS start_lng,
min(started_at) AS earliest, max(started_at) AS latest FROM nt
WHERE start_station_id IS NOT NULL AND start_station_name IS NOT NULL GROUP BY 1, 2"""
_add("named_coordinates", _COORD, "start_lat", "start_lng")
_add(
    "latest_coordinates",
    f"""SELECT start_station_id AS station_id, start_lat AS lat, start_lng AS lng FROM (
SELECT *, rank() OVER (PARTITION BY start_station_id ORDER BY latest DESC) AS r FROM ({_COORD})) WHERE r = 1""",
    *_STATION,
)
_add(
    "address_json",
    """SELECT c_custkey, CASE WHEN c_custkey % 6 < 4 THEN n_name ELSE 'Unknown' END AS city,
CASE WHEN c_custkey % 6 < 5 THEN r_name ELSE 'Unknown' END AS state,
CASE WHEN c_custkey % 6 < 5 THEN lpad(CAST(c_nationkey AS VARCHAR), 5, '0') ELSE 'Unknown' END AS zip_code
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
_add(
    "enrich_dimension",
    """SELECT station_id, station_name, lat, lng, earliest_seen, latest_seen,
CASE WHEN station_id % 3 < 2 THEN upper(station_name) ELSE city END AS city,
CASE WHEN station_id % 3 < 2 THEN 'Unknown' ELSE state END AS state,
CASE WHEN station_id % 3 < 2 THEN CAST(station_id AS VARCHAR) ELSE zip_code END AS zip_code FROM s""",
    *_STATION,
)
_ACTIVE = "coalesce(CAST(latest_seen AS DATE) >= (SELECT max(date) FROM station_daily) - 30, false)"
_STATUS = f"CASE WHEN {_ACTIVE} THEN 'Active' ELSE 'Discontinued' END"
_add(
    "station_status",
    f"SELECT station_id, station_name, latest_seen, {_STATUS} AS status FROM s",
)
_add(
    "station_profile",
    f"""SELECT station_name, station_id,
CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN printf('%.6f, %.6f', lat, lng) ELSE 'Coordinates unavailable' END AS location,
coalesce(city, 'Unknown') || ', ' || coalesce(state, 'Unknown') || ' ' || coalesce(zip_code, 'Unknown') AS address,
CAST(earliest_seen AS DATE) AS first_observed,
CASE WHEN {_ACTIVE} THEN 'Currently Active'
     ELSE coalesce('Discontinued ' || CAST(CAST(latest_seen AS DATE) AS VARCHAR), 'Discontinued') END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY station_name ORDER BY station_id) AS r FROM s) WHERE r = 1""",
)
_add(
    "distinct_options",
    "SELECT DISTINCT city FROM s WHERE city IS NOT NULL AND city NOT IN ('', 'Unknown')",
)

# --- normalisation and files ---------------------------------------------------------
_add(
    "normalize_ids",
    """SELECT ride_id, CASE WHEN rideable_type = 'docked_bike' THEN NULL ELSE end_station_id END AS from_text,
end_station_id AS from_double FROM t""",
)
_add(
    "lenient_timestamps",
    """SELECT ride_id, parsed AS started_at, CAST(day(parsed) AS INTEGER) AS day, CAST(hour(parsed) AS INTEGER) AS hour,
CAST(isodow(parsed) AS INTEGER) AS weekday
FROM (SELECT ride_id, CASE WHEN rideable_type = 'docked_bike' THEN NULL ELSE started_at END AS parsed FROM t)""",
)
_add(
    "normalize_old_new_union",
    """SELECT CASE WHEN y < 1998 THEN NULL ELSE ride_id END AS ride_id, CASE WHEN y < 1998 THEN NULL ELSE rideable_type END AS rideable_type,
started_at, ended_at, duration_sec, start_station_id, start_station_name,
CASE WHEN y < 1998 THEN start_lat ELSE CAST(38.5 AS DOUBLE) END AS start_lat,
CASE WHEN y < 1998 THEN start_lng ELSE CAST(-77.5 AS DOUBLE) END AS start_lng,
end_station_id, end_station_name,
CASE WHEN y < 1998 THEN end_lat ELSE CAST(38.25 AS DOUBLE) END AS end_lat,
CASE WHEN y < 1998 THEN end_lng ELSE CAST(-77.25 AS DOUBLE) END AS end_lng,
CASE WHEN y < 1998 THEN bike_number END AS bike_number, member_type,
CAST(day(started_at) AS INTEGER) AS day, CAST(hour(started_at) AS INTEGER) AS hour, CAST(isodow(started_at) AS INTEGER) AS weekday
FROM (SELECT *, year(started_at) AS y FROM nt)""",
    *_ENDS,
)
_add("busy_months", "SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month FROM loaded")
_CALENDAR = """SELECT CAST(m // 12 AS INTEGER) AS year, CAST(m % 12 + 1 AS INTEGER) AS month FROM
(SELECT unnest(range(first, last + 1)) AS m FROM (SELECT min(year * 12 + month - 1) AS first, max(year * 12 + month - 1) AS last FROM loaded))"""
_add("missing_months", f"SELECT * FROM ({_CALENDAR}) c WHERE NOT EXISTS (SELECT 1 FROM loaded l WHERE l.year = c.year AND l.month = c.month)")
_add(
    "unloaded_months",
    """SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month FROM months
WHERE (year, month) NOT IN (SELECT year, month FROM loaded)""",
)
_add(
    "months_after_latest",
    """SELECT CAST(m // 12 AS INTEGER) AS year, CAST(m % 12 + 1 AS INTEGER) AS month FROM
(SELECT unnest(range(last + 1, 2003 * 12 + 3)) AS m FROM (SELECT max(year * 12 + month - 1) AS last FROM loaded))""",
)
_add(
    "file_kinds",
    """SELECT strftime(d, '%Y%m') || '.csv' AS file_name, 'monthly' AS kind, CAST(year AS INTEGER) AS file_year, CAST(month AS INTEGER) AS file_month
FROM (SELECT make_date(year, month, 1) AS d, year, month FROM months)
UNION ALL SELECT DISTINCT CAST(year AS VARCHAR) || '.parquet', 'bulk', CAST(year AS INTEGER), CAST(NULL AS INTEGER) FROM months
UNION ALL SELECT strftime(make_date(year, month, 1), '%Y%m') || '0.csv', 'ignore', NULL, NULL FROM months
UNION ALL SELECT 'readme_' || strftime(make_date(year, month, 1), '%Y%m') || '.csv', 'ignore', NULL, NULL FROM months""",
)
_add(
    "expected_files",
    """SELECT y AS year, m AS month, CAST(y AS VARCHAR) || coalesce(lpad(CAST(m AS VARCHAR), 2, '0'), '') AS file_stem FROM
(SELECT CAST(year + 20 AS INTEGER) AS y,
        unnest(CASE WHEN year + 20 >= 2018 THEN CAST(range(1, 13) AS INTEGER[]) ELSE [CAST(NULL AS INTEGER)] END) AS m
 FROM (SELECT DISTINCT year FROM months))""",
)
_add("filtered_read", "SELECT * FROM lineitem WHERE l_returnflag = 'R'")

# --- station pages -------------------------------------------------------------------
_DAYS = "(SELECT *, num_checkouts - num_returns AS nf FROM station_daily WHERE station_id IS NOT NULL)"


def _grid(metric: str) -> str:
    return f"""SELECT station_id, CAST(weekday AS INTEGER) AS weekday, CAST(hour AS INTEGER) AS hour, coalesce(avg_value, 0) AS avg_value
FROM (SELECT DISTINCT station_id FROM station_hourly WHERE station_id IS NOT NULL)
CROSS JOIN (SELECT unnest(range(1, 8)) AS weekday) CROSS JOIN (SELECT unnest(range(0, 24)) AS hour)
LEFT JOIN (SELECT station_id, isodow(date) AS weekday, hour, CAST(avg({metric}) AS DOUBLE) AS avg_value
           FROM station_hourly GROUP BY ALL) USING (station_id, weekday, hour)"""


_add("hourly_grid", _grid("num_checkouts"), "avg_value")
_add("hourly_grid_returns", _grid("num_returns"), "avg_value")
_add("hourly_grid_net_flow", _grid("net_flow"), "avg_value")
_add(
    "grid_range",
    f"""SELECT station_id, -m AS zmin, m AS zmax FROM (SELECT station_id, coalesce(nullif(max(abs(avg_value)), 0), 1) AS m
FROM ({_grid("net_flow")}) GROUP BY 1)""",
    "zmin",
    "zmax",
)
_add(
    "pressure_days",
    f"""SELECT station_id, date, nf AS net_flow, threshold FROM (
SELECT station_id, date, nf, a, max(CASE WHEN i = CAST(floor((n - 1) * CAST(0.9 AS DOUBLE) + 0.5) AS BIGINT) THEN a END)
 OVER (PARTITION BY station_id) AS threshold
FROM (SELECT station_id, date, nf, abs(nf) AS a, row_number() OVER (PARTITION BY station_id ORDER BY abs(nf)) - 1 AS i,
 count(*) OVER (PARTITION BY station_id) AS n FROM {_DAYS})) WHERE a > threshold""",
)
_add(
    "flow_class",
    f"""SELECT station_id, m AS avg_net_flow, CASE WHEN m > 10 THEN 'departure' WHEN m < -10 THEN 'arrival' ELSE 'balanced' END AS flow_class
FROM (SELECT station_id, avg(nf) AS m FROM {_DAYS} GROUP BY 1)""",
    "avg_net_flow",
)
_add(
    "station_overview",
    f"""SELECT *, total_trips / active_days AS avg_daily_trips FROM (
SELECT station_id, CAST(sum(num_checkouts + num_returns) // 2 AS BIGINT) AS total_trips, avg(avg_duration_sec) / 60 AS avg_duration_min,
count(*) AS active_days FROM {_DAYS} GROUP BY 1)""",
    "avg_duration_min",
    "avg_daily_trips",
)
_add(
    "station_totals",
    f"""SELECT station_id, CAST(sum(num_checkouts) AS BIGINT) AS total_checkouts, CAST(sum(num_returns) AS BIGINT) AS total_returns,
CAST(sum(nf) AS BIGINT) AS net_flow FROM {_DAYS} GROUP BY 1""",
)
for _metric in ("num_checkouts", "avg_duration_sec"):
    _value = _metric if _metric == "num_checkouts" else "avg_duration_sec / 60"
    _key = "station_series" if _metric == "num_checkouts" else "station_series_minutes"
    _add(_key, f"SELECT station_id, date, {_value} AS value FROM {_DAYS}", *(() if _metric == "num_checkouts" else ("value",)))

_RANGE = "date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"


def _map_detailed(out: str = "avg(avg_duration_checkout_sec)", back: str = "avg(avg_duration_return_sec)") -> str:
    return f"""SELECT station_id, total_checkouts, total_returns, station_name, o AS avg_duration_checkout_sec, b AS avg_duration_return_sec,
total_checkouts - total_returns AS net_flow, lat, lng, o / 60 AS avg_duration_checkout_min, b / 60 AS avg_duration_return_min, o AS avg_duration_sec
FROM (SELECT station_id, CAST(sum(num_checkouts) AS BIGINT) AS total_checkouts, CAST(sum(num_returns) AS BIGINT) AS total_returns,
max(station_name) AS station_name, {out} AS o, {back} AS b
FROM station_daily_detailed WHERE {_RANGE} AND {_USUAL} GROUP BY 1) LEFT JOIN (SELECT station_id, lat, lng FROM s) USING (station_id)"""


_MAP_DIGITS = (
    *_STATION,
    "avg_duration_checkout_sec",
    "avg_duration_return_sec",
    "avg_duration_checkout_min",
    "avg_duration_return_min",
    "avg_duration_sec",
)
_add("map_detailed", _map_detailed(), *_MAP_DIGITS)
_add(
    "map_detailed_weighted",
    _map_detailed(
        "sum(avg_duration_checkout_sec * num_checkouts) / nullif(sum(CASE WHEN avg_duration_checkout_sec IS NOT NULL THEN num_checkouts END), 0)",
        "sum(avg_duration_return_sec * num_returns) / nullif(sum(CASE WHEN avg_duration_return_sec IS NOT NULL THEN num_returns END), 0)",
    ),
    *_MAP_DIGITS,
)
_BASIC = f"""SELECT station_id, total_checkouts, total_returns, station_name, m AS avg_duration_sec,
total_checkouts - total_returns AS net_flow, lat, lng, m / 60 AS avg_duration_checkout_min, m / 60 AS avg_duration_return_min
FROM (SELECT station_id, CAST(sum(num_checkouts) AS BIGINT) AS total_checkouts, CAST(sum(num_returns) AS BIGINT) AS total_returns,
max(station_name) AS station_name, avg(avg_duration_sec) AS m FROM station_daily WHERE {_RANGE} GROUP BY 1)
LEFT JOIN (SELECT station_id, lat, lng FROM s) USING (station_id)"""
_add("map_basic", _BASIC, *_STATION, "avg_duration_sec", "avg_duration_checkout_min", "avg_duration_return_min")
_add(
    "map_marker_scale",
    f"""SELECT station_id, station_name, lat, lng, net_flow AS metric_value, 'Net Flow' AS metric_label,
CASE WHEN hi = lo THEN 12.5 ELSE 5 + (net_flow - lo) / (hi - lo) * 15 END AS radius
FROM ({_BASIC}) CROSS JOIN (SELECT CAST(min(net_flow) AS DOUBLE) AS lo, CAST(max(net_flow) AS DOUBLE) AS hi FROM ({_BASIC}))
WHERE lat <> 0 AND lng <> 0""",
    *_STATION,
    "radius",
)

# --- station table -------------------------------------------------------------------
_ELECTRIC = f"""SELECT station_id,
coalesce(CAST(sum(CASE WHEN rideable_type = 'electric_bike' THEN num_checkouts ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(num_checkouts) AS DOUBLE), 0) * 100, 0) AS pct_checkouts_electric,
coalesce(CAST(sum(CASE WHEN rideable_type = 'electric_bike' THEN num_returns ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(num_returns) AS DOUBLE), 0) * 100, 0) AS pct_returns_electric
FROM station_daily_detailed WHERE {_RANGE} AND rideable_type <> 'unknown' GROUP BY 1"""
_PCT = ("pct_checkouts_electric", "pct_returns_electric")
_add("electric_share", _ELECTRIC, *_PCT)
_TABLE = f"""SELECT s.station_id, s.station_name, s.city, s.state, s.zip_code, s.lat, s.lng, s.earliest_seen, s.latest_seen,
coalesce(c, 0) AS total_checkouts, coalesce(r, 0) AS total_returns, coalesce(c + r, 0) AS total_trips, coalesce(c - r, 0) AS net_flow,
coalesce(m, 0) AS avg_duration_min, coalesce(b, 0) AS total_distinct_bikes,
CASE WHEN x.station_id IS NOT NULL THEN coalesce(pct_checkouts_electric, 0) END AS pct_checkouts_electric,
CASE WHEN x.station_id IS NOT NULL THEN coalesce(pct_returns_electric, 0) END AS pct_returns_electric,
{_STATUS} AS status
FROM s LEFT JOIN (SELECT station_id, CAST(sum(num_checkouts) AS BIGINT) AS c, CAST(sum(num_returns) AS BIGINT) AS r,
 avg(avg_duration_sec) / 60 AS m, CAST(sum(distinct_bikes_out) AS BIGINT) AS b FROM station_daily WHERE {_RANGE} GROUP BY 1) x USING (station_id)
LEFT JOIN ({_ELECTRIC}) USING (station_id)"""
_add("station_table", _TABLE, *_STATION, "avg_duration_min", *_PCT)
_add(
    "station_table_filtered",
    f"SELECT * FROM ({_TABLE}) WHERE status = 'Active' AND total_trips >= 5 AND zip_code IN ('20001', '20003', '20005', '20007')",
    *_STATION,
    "avg_duration_min",
    *_PCT,
)
_add(
    "station_table_summary",
    f"""SELECT count(*) AS total_stations, count(*) FILTER (status = 'Active') AS active_stations,
count(*) FILTER (status = 'Discontinued') AS discontinued_stations, CAST(sum(total_trips) AS BIGINT) AS total_trips FROM ({_TABLE})""",
)

# --- routes --------------------------------------------------------------------------
_ORDER = "trip_count DESC, start_station_id, end_station_id"
_add(
    "outbound_routes",
    f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY start_station_id ORDER BY {_ORDER}) AS INTEGER) AS position
FROM station_routes) WHERE position <= 10""",
    *_ENDS,
    *_DUR,
)
_add(
    "inbound_routes",
    """SELECT * FROM (SELECT end_station_id AS start_station_id, end_station_name AS start_station_name, end_lat AS start_lat, end_lng AS start_lng,
start_station_id AS end_station_id, start_station_name AS end_station_name, start_lat AS end_lat, start_lng AS end_lng, trip_count, avg_duration_sec,
CAST(row_number() OVER (PARTITION BY end_station_id ORDER BY trip_count DESC, end_station_id, start_station_id) AS INTEGER) AS position
FROM station_routes) WHERE position <= 10""",
    *_ENDS,
    *_DUR,
)
_TOP = f"""SELECT *, CAST(row_number() OVER (ORDER BY {_ORDER}) AS INTEGER) AS position,
start_station_name || ' → ' || end_station_name AS route FROM station_routes ORDER BY {_ORDER} LIMIT 20"""
_add("top_routes", _TOP, *_ENDS, *_DUR)
_add(
    "route_table",
    f"SELECT position, route, trip_count, round(avg_duration_sec / 60, 1) AS avg_duration_min FROM ({_TOP})",
)
_add(
    "top_routes_filtered",
    """SELECT *, start_station_name || ' → ' || end_station_name AS route FROM (
SELECT *, CAST(row_number() OVER (ORDER BY trip_count DESC, start_station_name NULLS FIRST, end_station_name NULLS FIRST) AS INTEGER) AS position FROM (
SELECT start_station_name, end_station_name, CAST(sum(trip_count) AS BIGINT) AS trip_count, avg(avg_duration_sec) AS avg_duration_sec
FROM typed_routes WHERE member_type IN ('member') GROUP BY 1, 2)) WHERE position <= 20""",
    *_DUR,
)
_add(
    "route_kpis",
    f"""SELECT (SELECT count(*) FROM station_routes) AS total_routes, max(trip_count) AS most_popular_trips,
avg(trip_count) AS avg_trips_top_20 FROM ({_TOP})""",
    "avg_trips_top_20",
)
_add(
    "route_map",
    f"""SELECT start_station_id, position, end_station_id, end_station_name, end_lat, end_lng, trip_count,
CASE WHEN hi = lo THEN 5 ELSE 2 + CAST(trip_count - lo AS DOUBLE) / (hi - lo) * 6 END AS weight FROM (
SELECT *, min(trip_count) OVER (PARTITION BY start_station_id) AS lo, max(trip_count) OVER (PARTITION BY start_station_id) AS hi FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY start_station_id ORDER BY {_ORDER}) AS INTEGER) AS position FROM station_routes)
WHERE position <= 10) WHERE end_lat <> 0 AND end_lng <> 0""",
    "end_lat",
    "end_lng",
    "weight",
)
_BOTH = "start_lat <> 0 AND start_lng <> 0 AND end_lat <> 0 AND end_lng <> 0"
_add(
    "system_route_map",
    f"""SELECT position, start_station_name, start_lat, start_lng, end_station_name, end_lat, end_lng, trip_count,
CASE WHEN hi = lo THEN 0.5 ELSE CAST(trip_count - lo AS DOUBLE) / (hi - lo) END AS color_position,
CASE WHEN hi = lo THEN 4 ELSE 2 + CAST(trip_count - lo AS DOUBLE) / (hi - lo) * 4 END AS weight
FROM (SELECT *, min(trip_count) OVER () AS lo, max(trip_count) OVER () AS hi FROM ({_TOP})) WHERE {_BOTH}""",
    *_ENDS,
    "color_position",
    "weight",
)
_ALL_ENDS = """SELECT position, 0 AS i, start_station_name AS station_name, start_lat AS lat, start_lng AS lng FROM top20
UNION ALL SELECT position, 1, end_station_name, end_lat, end_lng FROM top20"""
_add(
    "route_centroid",
    f"""SELECT coalesce(avg(lat), 38.9072) AS center_lat, coalesce(avg(lng), -77.0369) AS center_lng
FROM ({_ALL_ENDS.replace("top20", f"({_TOP})")}) WHERE lat <> 0 AND lng <> 0""",
    "center_lat",
    "center_lng",
)
_add(
    "route_endpoints",
    f"""SELECT station_name, lat, lng FROM (SELECT *, row_number() OVER (PARTITION BY lat, lng ORDER BY position, i) AS r
FROM ({_ALL_ENDS.replace("top20", f"(SELECT * FROM ({_TOP}) WHERE {_BOTH})")})) WHERE r = 1""",
    *_STATION,
)

# --- system pages --------------------------------------------------------------------
_add("coverage", "SELECT min(date) AS min_date, max(date) AS max_date, count(*) AS rows FROM system_daily")
_add(
    "system_kpis",
    f"""SELECT CAST(sum(trips) AS BIGINT) AS total_trips, avg(avg_duration_sec) / 60 AS avg_duration_min, count(*) AS num_days,
CAST(sum(trips) AS DOUBLE) / count(*) AS avg_daily_trips FROM system_daily WHERE {_RANGE}""",
    "avg_duration_min",
    "avg_daily_trips",
)
_PATTERNS = "trip_patterns"
_MONTHS = "year_month BETWEEN '1996-01' AND '2000-12'"
_HOURS = f"SELECT hour, CAST(sum(trip_count) AS BIGINT) AS trip_count FROM {_PATTERNS} GROUP BY 1"
_add("trips_by_hour", _HOURS)
_add("patterns_filtered", _HOURS.replace(_PATTERNS, f"(SELECT * FROM {_PATTERNS} WHERE {_MONTHS})"))
_add(
    "peak_hours",
    f"SELECT *, CAST(row_number() OVER (ORDER BY trip_count DESC, hour) AS INTEGER) AS position FROM ({_HOURS}) ORDER BY position LIMIT 3",
)
_add(
    "trips_by_weekday",
    f"""SELECT weekday, CAST(sum(trip_count) AS BIGINT) AS trip_count,
CASE weekday WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu' WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' ELSE 'Sun' END AS weekday_label
FROM {_PATTERNS} GROUP BY 1""",
)
_BUCKETS = "(SELECT bucket_start_min AS b, CAST(sum(trip_count) AS BIGINT) AS n FROM trip_duration_buckets GROUP BY 1)"
_add(
    "duration_histogram",
    f"""SELECT b AS bucket_start_min, CASE WHEN b = 120 THEN '120+' ELSE CAST(b AS VARCHAR) || '–' || CAST(b + 5 AS VARCHAR) END AS label,
n AS trip_count, CAST(sum(n) OVER (ORDER BY b) AS BIGINT) AS running FROM {_BUCKETS}""",
)
_STATS = f"""SELECT CAST(sum(n) AS BIGINT) AS total_trips, sum((b + 2.5) * n) / sum(n) AS mean_min,
CAST(min(CASE WHEN c >= 0.5 * total THEN b END) + 2.5 AS DOUBLE) AS median_min,
CAST(coalesce(min(CASE WHEN c >= 0.99 * total THEN b END), max(b)) + 5 AS DOUBLE) AS p99_min
FROM (SELECT *, sum(n) OVER (ORDER BY b) AS c, sum(n) OVER () AS total FROM {_BUCKETS})"""
_add("duration_stats", _STATS, "mean_min")
_add("duration_stats_filtered", _STATS.replace("GROUP BY 1)", f"WHERE {_MONTHS} AND member_type IN ('member') GROUP BY 1)"), "mean_min")
_add(
    "duration_ranges",
    f"""SELECT label AS range, CAST(coalesce(sum(n), 0) AS BIGINT) AS trip_count,
CAST(coalesce(sum(n), 0) AS DOUBLE) / (SELECT sum(n) FROM {_BUCKETS}) * 100 AS pct
FROM (VALUES ('Quick (0–10 min)', 0, 10), ('Short (10–20 min)', 10, 20), ('Medium (20–30 min)', 20, 30),
      ('Long (30–60 min)', 30, 60), ('Very Long (60+ min)', 60, 9999)) v(label, lo, hi)
LEFT JOIN {_BUCKETS} x ON b >= lo AND b < hi GROUP BY 1""",
    "pct",
)
_DETAIL = "system_daily_detailed"
_TREND = f"SELECT date, CAST(sum(trips) AS BIGINT) AS trips FROM {_DETAIL} GROUP BY 1"
_add("daily_trend", _TREND)
_add("daily_trend_filtered", _TREND.replace(_DETAIL, f"(SELECT * FROM {_DETAIL} WHERE {_RANGE})"))
_add(
    "busiest_quietest",
    f"""SELECT (SELECT date FROM ({_TREND}) ORDER BY trips DESC, date LIMIT 1) AS busiest_date, max(trips) AS busiest_trips,
(SELECT date FROM ({_TREND}) ORDER BY trips, date LIMIT 1) AS quietest_date, min(trips) AS quietest_trips FROM ({_TREND})""",
)
_add("by_member", f'SELECT member_type, CAST(sum(trips) AS BIGINT) AS "count" FROM {_DETAIL} GROUP BY 1')
_add(
    "by_rideable",
    f"""SELECT rideable_type, CAST(sum(trips) AS BIGINT) AS "count" FROM {_DETAIL} WHERE rideable_type <> 'unknown' GROUP BY 1""",
)
_add(
    "annual_totals",
    f"SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(trips) AS BIGINT) AS trips FROM {_DETAIL} GROUP BY 1",
)


def _summary(level: str) -> str:
    return f"""SELECT *, avg_duration_sec / 60 AS avg_duration_min FROM (
SELECT agg_value, agg_sort_key, CAST(sum(total_checkouts) AS BIGINT) AS checkouts, CAST(sum(total_returns) AS BIGINT) AS returns,
CAST(sum(net_flow) AS BIGINT) AS net_flow, avg(avg_duration_sec) AS avg_duration_sec, CAST(sum(total_trips) AS BIGINT) AS total_trips
FROM time_aggregated WHERE agg_level = '{level}' AND {_USUAL} GROUP BY 1, 2)"""


_add("time_summary", _summary("day"), "avg_duration_sec", "avg_duration_min")
_add("time_summary_dow", _summary("day_of_week"), "avg_duration_sec", "avg_duration_min")
_add(
    "time_kpis",
    f"""SELECT CAST(sum(checkouts) AS BIGINT) AS total_checkouts, CAST(sum(returns) AS BIGINT) AS total_returns,
CAST(sum(net_flow) AS BIGINT) AS net_flow, avg(avg_duration_min) AS avg_duration_min FROM ({_summary("month")})""",
    "avg_duration_min",
)
_add(
    "time_table",
    f"SELECT agg_value, checkouts, returns, net_flow, total_trips, round(avg_duration_min, 1) AS avg_duration_min FROM ({_summary('year')})",
)
_INSIGHT = """SELECT '{kind}' AS kind, agg_value, {kind} AS trips FROM ({summary}) WHERE {kind} = (SELECT max({kind}) FROM ({summary}))"""
_add(
    "time_insights",
    f"""SELECT * FROM ({" UNION ALL ".join(_INSIGHT.format(kind=k, summary=_summary("day")) for k in ("checkouts", "returns"))})
CROSS JOIN (SELECT avg(avg_duration_min) AS avg_duration_min, CAST(sum(total_trips) AS BIGINT) AS total_trips FROM ({_summary("day")}))""",
    "avg_duration_min",
)
for _step in ("week", "month"):
    _add(
        f"resample_{_step}ly",
        f"""SELECT CAST(date_trunc('{_step}', date) AS DATE) AS date, CAST(sum(trips) AS BIGINT) AS trips,
avg(avg_duration_sec) AS avg_duration_sec FROM system_daily GROUP BY 1""",
        *_DUR,
    )
_add(
    "resample_weekly_weighted",
    """SELECT CAST(date_trunc('week', date) AS DATE) AS date, CAST(sum(trips) AS BIGINT) AS trips,
sum(avg_duration_sec * trips) / sum(trips) AS avg_duration_sec FROM system_daily GROUP BY 1""",
    *_DUR,
)
_FIT = """SELECT p.*, CASE WHEN p.{y} IS NOT NULL THEN slope * date_diff('day', d0, p.date) + icept END AS trend FROM ({src}) p
CROSS JOIN (SELECT regr_slope(CAST({y} AS DOUBLE), date_diff('day', d0, date)) AS slope,
                   regr_intercept(CAST({y} AS DOUBLE), date_diff('day', d0, date)) AS icept, any_value(d0) AS d0
            FROM ({src}) CROSS JOIN (SELECT min(date) AS d0 FROM ({src})))"""
_add("trend_line", _FIT.format(y="trips", src="SELECT date, trips FROM system_daily"), "trend")
_add(
    "trend_line_gaps",
    _FIT.format(y="y", src="SELECT date, CASE WHEN trips % 5 <> 0 THEN avg_duration_sec END AS y FROM system_daily"),
    "y",
    "trend",
)

# --- journeys ------------------------------------------------------------------------
_add(
    "bike_journeys",
    """SELECT j.*, a.lat AS start_lat, a.lng AS start_lng, b.lat AS end_lat, b.lng AS end_lng FROM (
SELECT ride_id, bike_number, started_at, ended_at, start_station_id, end_station_id, row_number() OVER w AS ride_number,
CAST(start_station_id = lag(end_station_id) OVER w AS DOUBLE) AS continuous
FROM t WHERE bike_number IS NOT NULL WINDOW w AS (PARTITION BY bike_number ORDER BY started_at, ended_at, ride_id)) j
LEFT JOIN s a ON a.station_id = start_station_id LEFT JOIN s b ON b.station_id = end_station_id""",
    *_ENDS,
)
_add(
    "station_imbalance",
    """SELECT *, end_counts - start_counts AS diff, CAST(end_counts AS DOUBLE) / start_counts AS ratio
FROM (SELECT start_station_name, count(*) AS start_counts FROM nt WHERE start_station_name IS NOT NULL GROUP BY 1)
JOIN (SELECT end_station_name, count(*) AS end_counts FROM nt WHERE end_station_name IS NOT NULL GROUP BY 1)
ON start_station_name = end_station_name""",
    "ratio",
)
_BUBBLE = """SELECT start_station_id, start_station_name, start_lat, start_lng, num_checkouts,
greatest(num_checkouts, 80) AS num_checkouts_adj, sqrt(greatest(num_checkouts, 80)) AS sqrt_num_checkouts, '{era}' AS era
FROM (SELECT start_station_id, start_station_name, count(*) AS num_checkouts FROM nt WHERE {when} GROUP BY 1, 2)
JOIN ({coord}) USING (start_station_id, start_station_name)"""
_add(
    "era_bubbles",
    _BUBBLE.format(era="before", when="year(started_at) < 1998", coord=_COORD)
    + " UNION ALL "
    + _BUBBLE.format(era="after", when="year(started_at) >= 1998", coord=_COORD),
    "start_lat",
    "start_lng",
    "sqrt_num_checkouts",
)


# --- files and stored tables ---------------------------------------------------------
# Rides as they lie in raw files, with the partition each comes to. A ride of a bulk year
# whose month has a monthly file is left out; the file's month stands for monthly files.
_PARTS["r"] = """
SELECT *, year(started_at) AS y, rideable_type IS NOT DISTINCT FROM 'docked_bike' AND start_station_id % 10 = 3 AS no_start,
       rideable_type IS NOT DISTINCT FROM 'docked_bike' AND end_station_id % 10 = 7 AS no_end,
       CASE WHEN year(started_at) >= 1998 AND end_station_id % 37 = 0 THEN CAST(started_at AS DATE) + INTERVAL 2 MONTH ELSE started_at END AS fm
FROM nt"""
_PARTS["l"] = """
SELECT CASE WHEN y >= 1998 THEN ride_id END AS ride_id, CASE WHEN y >= 1998 THEN rideable_type END AS rideable_type,
       CASE WHEN y < 1998 OR NOT coalesce(no_start, false) THEN started_at END AS started_at, ended_at,
       CASE WHEN y < 1998 OR NOT coalesce(no_start, false) THEN duration_sec END AS duration_sec,
       start_station_id, start_station_name,
       CASE WHEN y >= 1998 THEN 38.5::DOUBLE ELSE start_lat END AS start_lat, CASE WHEN y >= 1998 THEN -77.5::DOUBLE ELSE start_lng END AS start_lng,
       CASE WHEN y < 1998 OR NOT coalesce(no_end, false) THEN end_station_id END AS end_station_id, end_station_name,
       CASE WHEN y >= 1998 THEN 38.25::DOUBLE ELSE end_lat END AS end_lat, CASE WHEN y >= 1998 THEN -77.25::DOUBLE ELSE end_lng END AS end_lng,
       CASE WHEN y < 1998 THEN bike_number END AS bike_number, member_type,
       CAST(year(fm) AS INTEGER) AS year, CAST(month(fm) AS INTEGER) AS month,
       CASE WHEN y < 1993 THEN '1992.csv' WHEN y = 1995 THEN '1995.parquet' WHEN y <= 1994 AND NOT (y = 1994 AND month(started_at) = 6) THEN y || '.csv'
            ELSE strftime(fm, '%Y%m') || '.csv' END AS file_name,
       y >= 1998 AND coalesce(no_start, false) AS bad_start, y >= 1998 AND coalesce(no_end, false) AS bad_end
FROM r WHERE NOT (y = 1994 AND month(started_at) = 6 AND member_type IS DISTINCT FROM 'member')"""
_LOADED = """ride_id, rideable_type, started_at, ended_at, duration_sec, start_station_id, start_station_name, start_lat, start_lng, end_station_id,
end_station_name, end_lat, end_lng, bike_number, member_type, CAST(day(started_at) AS INTEGER) AS day, CAST(hour(started_at) AS INTEGER) AS hour,
CAST(isodow(started_at) AS INTEGER) AS weekday, year, month"""
_add("ingest_csv", f"SELECT {_LOADED} FROM l", *_ENDS)
_add("ingest_bulk_split", "SELECT year, month, count(*) AS rides FROM l WHERE length(split_part(file_name, '.', 1)) = 4 GROUP BY 1, 2")
_add(
    "load_ledger",
    """SELECT file_name, CASE WHEN length(split_part(file_name, '.', 1)) = 4 THEN 'bulk' ELSE 'monthly' END AS kind, year, month, count(*) AS rides,
min(started_at) AS first_start, max(started_at) AS last_start, count_if(bad_start)::BIGINT AS unread_started_at, 0::BIGINT AS unread_ended_at,
0::BIGINT AS unread_start_station_id, count_if(bad_end)::BIGINT AS unread_end_station_id FROM l GROUP BY 1, 2, 3, 4""",
)
_add("loaded_months", "SELECT DISTINCT year, month FROM l")
_add("stored_months", "SELECT year, month, min(started_at) AS first_start, max(started_at) AS last_start, count(*) AS rides FROM l GROUP BY 1, 2")
_add("trips_between", "SELECT ride_id, started_at, year, month FROM l WHERE started_at >= DATE '1998-06-10' AND started_at < DATE '1998-09-21'")
_add(
    "ingest_reload",
    """SELECT CAST(1996 AS INTEGER) AS year, CAST(month(started_at) AS INTEGER) AS month,
count(*) + CASE WHEN month(started_at) = 3 THEN count(member_type) ELSE 0 END AS rides, month(started_at) IN (3, 12) AS opened
FROM t WHERE year(started_at) = 1996 AND (month(started_at) < 12 OR member_type IS NOT NULL) GROUP BY month(started_at)""",
)
_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_OLD = {
    "start_date": _TIME.format("started_at"), "end_date": _TIME.format("ended_at"), "start_station_number": "CAST(start_station_id AS VARCHAR)",
    "start_station": "start_station_name", "end_station_number": "CAST(end_station_id AS VARCHAR)", "end_station": "end_station_name",
    "member_type": "member_type", "bike_number": "bike_number",
}
_NEW = {
    "ride_id": "ride_id", "rideable_type": "rideable_type", "started_at": f"CASE WHEN no_start THEN 'n/a' ELSE {_TIME.format('started_at')} END",
    "ended_at": _TIME.format("ended_at"), "start_station_name": "start_station_name", "start_station_id": "start_station_id || '.0'",
    "end_station_name": "end_station_name", "end_station_id": "CASE WHEN no_end THEN 'none' ELSE CAST(end_station_id AS VARCHAR) END",
    "start_lat": "'38.5'", "start_lng": "'-77.5'", "end_lat": "'38.25'", "end_lng": "'-77.25'", "member_casual": "member_type",
}
_STACKED = " UNION ALL ".join(
    "SELECT " + ", ".join(f"{own.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in [*_OLD, *_NEW]) + f" FROM r WHERE {when} AND strftime(fm, '%Y%m') IN ({names})"
    for own, when, names in ((_OLD, "y < 1998", "'199711', '199712'"), (_NEW, "y >= 1998", "'199802', '199803'"))
)
_add("stack_drift", _STACKED)
_add(
    "numeric_ids",
    """SELECT ride_id, CAST(start_station_id AS DOUBLE) AS start_station_id, CAST(end_station_id AS DOUBLE) AS end_station_id
FROM r WHERE strftime(fm, '%Y%m') = '199805' AND start_station_id IS NOT NULL AND end_station_id IS NOT NULL AND NOT coalesce(no_end, false)""",
)
_add("stored_dimension", "SELECT * FROM s", "lat", "lng")
_add("dimension_merge", f"SELECT d.*, s.city, s.state, s.zip_code FROM ({_DIMENSION}) d LEFT JOIN s USING (station_id)", *_STATION)
_BUILT = ("system_daily", "system_daily_detailed", "station_daily", "station_daily_detailed", "station_hourly", "station_routes", "routes_by_member_rideable", "trip_patterns", "trip_duration_buckets", "time_aggregated")
ORACLES["build_all"] = " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n_rows FROM ({ORACLES[name]})" for name in _BUILT)
for _new, _same in (
    ("build_update_daily", "station_daily"),
    ("build_update_detailed", "station_daily_detailed"),
    ("build_update_hourly", "station_hourly"),
    ("build_update_routes", "station_routes"),
    ("build_analytics", "trip_patterns"),
):
    ORACLES[_new] = ORACLES[_same]
_add("csv_export", "SELECT strftime(started_at, '%B') AS agg_value, count(*) AS trips FROM t WHERE duration_sec > 0 GROUP BY 1")
ORACLES["journeys_of_bike"] = f"SELECT * FROM ({ORACLES['bike_journeys']}) WHERE bike_number = 'W00042'"
ORACLES["inbound_of_station"] = f"SELECT * FROM ({ORACLES['inbound_routes']}) WHERE start_station_id = 31005"
