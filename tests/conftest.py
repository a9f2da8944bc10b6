from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from ridelens.schemas import CANONICAL, STATIONS  # noqa: E402
from ridelens.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="3",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__sql__execution__arrow__pyspark__enabled="true",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


@pytest.fixture
def rides(spark):
    """Canonical rides from partial rows; duration follows from the times unless given."""

    def make(*rows: dict):
        full = []
        for i, row in enumerate(rows):
            row = {"ride_id": f"r{i}", **row}
            start, end = at(row.get("started_at", "2024-01-01 08:00:00")), row.get("ended_at", ...)
            seconds = row.get("duration_sec", 600)
            row["started_at"] = start
            if end is ...:
                row["ended_at"] = None if start is None else start + timedelta(seconds=seconds or 0)
            else:
                row["ended_at"] = at(end)
                if "duration_sec" not in row and None not in (start, row["ended_at"]):
                    seconds = int((row["ended_at"] - start).total_seconds())
            row["duration_sec"] = seconds
            full.append(tuple(row.get(f.name) for f in CANONICAL.fields))
        df = spark.createDataFrame(full, CANONICAL)
        return df.withColumns(
            {"day": F.dayofmonth("started_at"), "hour": F.hour("started_at"), "weekday": (F.weekday("started_at") + 1).cast("int")}
        )

    return make


@pytest.fixture
def dimension(spark):
    """Stations from (id, name, lat, lng, earliest, latest), later parts optional."""

    def make(*rows: tuple):
        full = [(*row, *([None] * (6 - len(row)))) for row in rows]
        return spark.createDataFrame([(*r[:4], at(r[4]), at(r[5])) for r in full], STATIONS)

    return make


def records(df, *order: str) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in order]) if order else rows


def plan_of(df, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
