from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import MEDIUM, SMALL, records
from ridelens import standins
from ridelens.operators.sequences import number_and_look_back
from ridelens.plans import journeys, stations


def test_journey_across_days(rides, dimension):
    trips = rides(
        {"bike_number": "b", "started_at": "2024-01-03 10:00:00", "start_station_id": 2, "end_station_id": 3},
        {"bike_number": "b", "started_at": "2024-01-01 10:00:00", "start_station_id": 1, "end_station_id": 2},
        {"bike_number": "b", "started_at": "2024-01-01 12:00:00", "start_station_id": 9, "end_station_id": 2},
        {"bike_number": "b", "started_at": "2024-01-04 10:00:00", "start_station_id": 3, "end_station_id": None},
        {"bike_number": "b", "started_at": "2024-01-05 10:00:00", "start_station_id": 3, "end_station_id": 1},
        {"bike_number": None, "started_at": "2024-01-01 10:00:00"},
    )
    got = records(journeys.bike_journeys(trips, dimension((1, "A", 5.0, 6.0))), "ride_number")
    assert [(r["ride_number"], r["continuous"]) for r in got] == [(1, None), (2, 0.0), (3, 1.0), (4, 1.0), (5, None)]
    assert (got[0]["start_lat"], got[-1]["end_lng"], got[1]["start_lat"]) == (5.0, 6.0, None)
    assert journeys.bike_journeys(trips, dimension(), "x").count() == 0


def test_sliced_numbering_matches_brute_force_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [
        ("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", rng.randrange(2_000), i, None if rng.random() < 0.1 else rng.randrange(9))
        for i in range(3_000)
    ]
    frame = pd.DataFrame(rows, columns=["k", "t", "i", "v"]).sort_values(["k", "t", "i"])
    frame["n"] = frame.groupby("k").cumcount() + 1
    frame["p"] = frame.groupby("k")["v"].shift()
    want = {r.i: (r.n, None if pd.isna(r.p) else int(r.p)) for r in frame.itertuples()}
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    for width in (1, 50, 10_000):
        got = number_and_look_back(df, "k", F.floor(F.col("t") / width), ["t", "i"], "v", "n", "p")
        assert {r.i: (r.n, r.p) for r in got.collect()} == want


@pytest.mark.parametrize("folder,counts", [(SMALL, (2_515, 22, 200, 23)), (MEDIUM, (25_662, 247, 500, 76))])
def test_golden_journeys(spark, folder, counts):
    got = journeys.bike_journeys(standins.trips_li(spark, folder), standins.stations(spark, folder, places=False))
    found = got.agg(
        F.count(F.lit(1)), F.sum("continuous").cast("int"), F.count_distinct("bike_number"), F.max("ride_number")
    ).first()
    assert tuple(found) == counts


def test_imbalance_needs_both_roles(rides):
    trips = rides(
        {"start_station_name": "A", "end_station_name": "B"},
        {"start_station_name": "B", "end_station_name": "A"},
        {"start_station_name": "B", "end_station_name": "C"},
        {"start_station_name": None, "end_station_name": "B"},
    )
    got = [(r.start_station_name, r.start_counts, r.end_counts, r["diff"], r.ratio) for r in journeys.station_imbalance(trips).collect()]
    assert got == [("A", 1, 1, 0, 1.0), ("B", 2, 2, 0, 1.0)]


def test_bubbles_of_two_eras(rides):
    row = {"start_station_id": 1, "start_station_name": "A", "start_lat": 1.0, "start_lng": 2.0}
    before, after = rides(row, row, {"start_station_id": 2, "start_station_name": "B"}), rides(row)
    got = records(journeys.era_bubbles(before, after, stations.named_coordinates(after), smallest=2), "era")
    assert [(r["era"], r["num_checkouts"], r["num_checkouts_adj"]) for r in got] == [("after", 1, 2), ("before", 2, 2)]
    assert got[0]["sqrt_num_checkouts"] == pytest.approx(2**0.5)
