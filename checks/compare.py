"""Run queries against their SQL: ``python -m checks.compare FOLDER [NAME ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from checks.oracle import ORACLES
from checks.queries import QUERIES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _texts(column: pd.Series) -> list[str]:
    """Values of a column as text that is the same for both engines."""
    kind = str(column.dtype)
    if kind.startswith(("int", "uint", "float")):
        return ["" if v != v else repr(float(v) + 0.0) for v in column.tolist()]
    missing = column.isna().tolist()
    if kind.startswith("datetime"):
        texts = column.dt.strftime("%Y-%m-%d %H:%M:%S.%f").tolist()
        return ["" if m else t.removesuffix(" 00:00:00.000000") for t, m in zip(texts, missing)]
    values = column.tolist()
    if any(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return ["" if m else repr(float(v) + 0.0) for v, m in zip(values, missing)]
    return ["" if m else f"={v}" if isinstance(v, str) else str(v) for v, m in zip(values, missing)]


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """What differs between two results, columns taken by name and rows in any order."""
    names = sorted(spark_frame.columns)
    if names != sorted(sql_frame.columns):
        return f"columns {names} vs {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} vs {len(sql_frame)}"
    ours, theirs = (sorted(zip(*[_texts(df[c]) for c in names])) for df in (spark_frame, sql_frame))
    if ours == theirs:
        return None
    apart = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(apart)} rows of {names}, first: {apart[:2]}"


def types_differ(spark_df, con, sql: str) -> list[str]:
    """Columns whose SQL type is not the one Spark reports."""
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    found = {r[0]: r[1] for r in con.sql(f"DESCRIBE {sql}").fetchall()}
    return [f"{c}: {t} vs {found.get(c)}" for c, t in spark_df.dtypes if names.get(t) != found.get(c)]


def main() -> int:
    from ridelens.session import build_session

    folder, only = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g", spark__sql__execution__arrow__pyspark__enabled="true")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in only or QUERIES:
        began = time.time()
        try:
            df = QUERIES[name](spark, folder)
            frame = df.toPandas()
            took = time.time() - began
            if name not in ORACLES:
                print(f"{name}: no SQL, {len(frame)} rows, {took:.2f}s", flush=True)
                continue
            sql_began = time.time()
            found = difference(frame, con.sql(ORACLES[name]).df())
            sql_took = time.time() - sql_began
            types = types_differ(df, con, ORACLES[name])
        except Exception as error:  # report and go on with the next query
            found, took, sql_took, types, frame = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0, [], []
        failed += found is not None
        print(f"{name}: {'ok' if found is None else 'DIFFERS ' + found} {len(frame)} rows {took:.2f}s sql {sql_took:.2f}s {types or ''}", flush=True)
    print(f"{failed} of {len(only or QUERIES)} differ; without SQL: {sorted(set(QUERIES) - set(ORACLES))}; SQL only: {sorted(set(ORACLES) - set(QUERIES))}")
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
