"""The shape of the plans: what must not appear, and what a hot key turns into."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from conftest import SMALL, plan_of
from ridelens.operators.lookup import attach


def test_rides_are_scanned_once_per_flow_table(spark):
    for name in ("station_daily", "station_daily_detailed", "station_hourly"):
        plan = plan_of(QUERIES[name](spark, SMALL), "simple")
        assert plan.count("lineitem.parquet") == 1, name


@pytest.mark.parametrize(
    "name, scans",
    [("hourly_grid", 1), ("grid_range", 1), ("station_imbalance", 1), ("era_bubbles", 1), ("station_routes", 1), ("routes_by_member_rideable", 1)],
)
def test_inputs_are_read_once(spark, name, scans):
    assert plan_of(QUERIES[name](spark, SMALL), "simple").count("lineitem.parquet") == scans


@pytest.mark.parametrize("name", ["map_marker_scale", "system_route_map", "time_insights"])
def test_figures_of_a_whole_column_are_one_more_read(spark, name):
    df = QUERIES[name](spark, SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert len(set(re.findall(r"[^d]Subquery subquery#(\d+)", final)) - set(re.findall(r"ReusedSubquery Subquery subquery#(\d+)", final))) <= 1


def test_journeys_read_one_shuffle_twice(spark):
    df = QUERIES["bike_journeys"](spark, SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert final.count("lineitem.parquet") == 1 and "ReusedExchange [ride_id" in final


def test_scans_read_only_the_columns_they_need(spark):
    plan = plan_of(QUERIES["system_daily"](spark, SMALL))
    read = re.search(r"ReadSchema: struct<(.*?)>\n", plan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_shipdate"}


def test_top_k_per_group_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(QUERIES["outbound_routes"](spark, SMALL))
    assert "WindowGroupLimit" in plan_of(QUERIES["station_dimension"](spark, SMALL))


@pytest.fixture
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("hot", ["1", "null"])
def test_lookup_splits_a_hot_key_when_the_dimension_is_too_big_to_broadcast(spark, no_broadcast, hot):
    facts = spark.range(0, 90_000, numPartitions=12).select(
        F.expr(f"if(id % 3 = 0, {hot}, id % 1000)").cast("bigint").alias("station_id"), F.md5(F.col("id").cast("string")).alias("x")
    )
    dimension = spark.range(1_000).select(F.col("id").alias("station_id"), F.lit("n").alias("station_name"))
    df = attach(facts, dimension, "station_id", name="station_name")
    assert len(df.collect()) == 90_000
    assert "SortMergeJoin(skew=true)" in df._jdf.queryExecution().executedPlan().toString()
