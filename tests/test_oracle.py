"""Every query against its SQL on the smallest tables, and what its plan must not hold."""

from __future__ import annotations

import re

import pytest

from checks.compare import connect, difference, types_differ
from checks.oracle import ORACLES
from checks.queries import QUERIES
from conftest import SMALL, plan_of

# Windows without a partition: over the k rows of a top-k, 25 duration buckets, or the
# slots of the sample's hash space.
ONE_TASK_WINDOWS = {
    "top_routes",
    "top_routes_filtered",
    "route_table",
    "route_kpis",
    "system_route_map",
    "route_endpoints",
    "peak_hours",
    "duration_histogram",
    "duration_stats",
    "duration_stats_filtered",
    "station_daily_sample",
}


@pytest.fixture(scope="module")
def sql():
    with connect(SMALL) as con:
        yield con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SMALL)
    check_plan(name, plan_of(df))
    assert difference(df.toPandas(), sql.sql(ORACLES[name]).df()) is None
    assert types_differ(df, sql, ORACLES[name]) == []


def check_plan(name: str, plan: str) -> None:
    """No crossed tables, no Python in the data path, no rows gathered in one place."""
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "CollectLimit"):
        assert operator not in plan
    assert "collect_list" not in plan and "collect_set" not in plan
    windows = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan)
    alone = [w for w in windows if re.match(r"_?\w+#\d+L? (ASC|DESC)", w.strip())]
    assert bool(alone) == (name in ONE_TASK_WINDOWS)
