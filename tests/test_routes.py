from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL, records
from ridelens import standins
from ridelens.operators.ranking import top_ties_per_group, within_average_rank
from ridelens.plans import routes


@pytest.mark.parametrize("n,kept", [(1, 1), (2, 1), (3, 3), (4, 4)])
def test_average_rank_keeps_or_drops_ties_whole(spark, n, kept):
    df = spark.createDataFrame([("g", v) for v in (9, 7, 7, 5)], "g string, v int")
    assert within_average_rank(df, ["g"], "v", n).count() == kept


def test_average_rank_matches_brute_force_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(30)}", rng.randrange(25), i) for i in range(4_000)]
    frame = pd.DataFrame(rows, columns=["g", "v", "i"])
    for n in (1, 5, 40, 600):
        rank = frame.groupby("g")["v"].rank(method="average", ascending=False)
        want = set(frame.loc[rank <= n, "i"])
        got = within_average_rank(spark.createDataFrame(frame), ["g"], "v", n)
        assert {r.i for r in got.collect()} == want


def test_first_place_ties_are_kept(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 4), (2, None), (2, 3)], "g int, v int")
    assert sorted((r.g, r.v) for r in top_ties_per_group(df, ["g"], F.desc_nulls_last("v")).collect()) == [(1, 5), (1, 5), (2, 3)]


def trips_between(rides, *edges):
    return rides(
        *[
            {"start_station_id": a, "end_station_id": b, "duration_sec": d, "member_type": m}
            for a, b, n, d, m in edges
            for _ in range(n)
        ]
    )


def test_routes_drop_round_trips_noise_and_unknown_ends(rides, dimension):
    trips = trips_between(
        rides, (1, 2, 10, 60, None), (1, 1, 20, 60, None), (1, 3, 9, 60, None), (None, 2, 30, 60, None), (2, 1, 11, -5, None)
    )
    got = records(routes.station_routes(trips, dimension((1, "A", 1.0, 2.0))), "start_station_id")
    assert [(r["start_station_id"], r["end_station_id"], r["trip_count"], r["avg_duration_sec"]) for r in got] == [
        (1, 2, 10, 60.0),
        (2, 1, 11, -5.0),
    ]
    assert [(r["start_station_name"], r["end_station_name"]) for r in got] == [("A", None), (None, "A")]


def test_route_listed_at_either_end_appears_once(rides, dimension):
    trips = trips_between(rides, (1, 2, 5, 60, None), (1, 3, 4, 60, None), (4, 3, 3, 60, None))
    got = routes.station_routes(trips, dimension(), top_n=1, min_trips=1)
    # 1-3 is second from station 1 but first into station 3; 4-3 is first from station 4.
    assert sorted((r.start_station_id, r.end_station_id) for r in got.collect()) == [(1, 2), (1, 3), (4, 3)]


def test_cube_gives_the_same_routes(spark, rides, dimension):
    trips, stations = standins.trips_li(spark, MEDIUM), standins.stations(spark, MEDIUM, places=False)
    cube = routes.edge_cube(trips)
    for direct, shared in (
        (routes.station_routes(trips, stations, 3), routes.station_routes(cube, stations, 3)),
        (routes.routes_by_member_rideable(trips, stations, 20, 2), routes.routes_by_member_rideable(cube, stations, 20, 2)),
    ):
        assert direct.exceptAll(shared).count() == shared.exceptAll(direct).count() == 0


@pytest.mark.parametrize("folder,top3,default", [(SMALL, 47, 47), (MEDIUM, 320, 494)])
def test_golden_routes(spark, folder, top3, default):
    trips, stations = standins.trips_li(spark, folder), standins.stations(spark, folder, places=False)
    assert routes.station_routes(trips, stations, top_n=3).count() == top3
    assert routes.station_routes(trips, stations).count() == default


ROUTES = "start_station_id long, start_station_name string, start_lat double, start_lng double, end_station_id long, end_station_name string, end_lat double, end_lng double, trip_count long, avg_duration_sec double"


@pytest.fixture
def table(spark):
    def place(i):
        return (i, f"S{i}", None, None) if i == 9 else (i, f"S{i}", 38.0 + i, -77.0 - i)

    def make(*edges):
        return spark.createDataFrame([(*place(a), *place(b), n, 60.0) for a, b, n in edges], ROUTES)

    return make


def test_inbound_turns_routes_around(table):
    got = records(routes.inbound_routes(table((1, 2, 5), (3, 2, 7), (2, 1, 1)), station_id=2), "position")
    assert [(r["start_station_name"], r["end_station_name"], r["end_lat"]) for r in got] == [("S2", "S3", 41.0), ("S2", "S1", 39.0)]


def test_route_map_counts_unplaced_ends_for_scale_and_position(table):
    got = records(routes.route_map(table((1, 9, 10), (1, 2, 6), (1, 3, 2)), station_id=1), "position")
    assert [(r["position"], r["weight"]) for r in got] == [(2, 5.0), (3, 2.0)]


def test_system_map_flat_counts_use_midpoints(table):
    got = records(routes.system_route_map(table((1, 2, 4), (2, 3, 4), (3, 9, 4))), "position")
    assert [(r["color_position"], r["weight"]) for r in got] == [(0.5, 4.0), (0.5, 4.0)]


def test_centroid_counts_placed_ends_and_falls_back(table):
    got = routes.route_centroid(table((1, 2, 4), (3, 9, 3))).first()
    assert (got.center_lat, got.center_lng) == (40.0, -79.0)
    assert tuple(routes.route_centroid(table((9, 9, 1))).first()) == routes.MAP_CENTER


def test_endpoints_once_each(table):
    got = routes.route_endpoints(table((1, 2, 4), (2, 3, 3), (3, 9, 2)))
    assert sorted(r.station_name for r in got.collect()) == ["S1", "S2", "S3"]


def test_filtered_top_routes_sum_types(spark, table):
    typed = spark.createDataFrame(
        [
            ("A", "B", "member", "classic_bike", 5, 60.0),
            ("A", "B", "member", "electric_bike", 3, 120.0),
            ("A", "C", "casual", "classic_bike", 9, 60.0),
            ("A", "D", "member", "unknown", 7, 60.0),
        ],
        "start_station_name string, end_station_name string, member_type string, rideable_type string, trip_count long, avg_duration_sec double",
    )
    got = records(routes.top_routes(table(), typed, members=("member",)), "position")
    # The untouched bike choice filters nothing, so the unknown type stays.
    assert [(r["route"], r["trip_count"], r["avg_duration_sec"]) for r in got] == [("A → B", 8, 90.0), ("A → D", 7, 60.0)]
    weighted = routes.top_routes(table(), typed, members=("member",), weighted=True)
    assert records(weighted, "position")[0]["avg_duration_sec"] == pytest.approx(82.5)


def test_route_kpis(table):
    df = table(*[(1, i, i) for i in range(2, 40)])
    got = routes.route_kpis(df, routes.top_routes(df, top_n=30)).first()
    assert tuple(got) == (38, 39, sum(range(20, 40)) / 20)
