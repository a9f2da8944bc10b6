"""Joins to the station dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, dimension: DataFrame, key: str, dimension_key: str = "station_id", **columns: str) -> DataFrame:
    """Left join ``dimension`` on ``key``, adding ``new_name="dimension_column"`` pairs.

    There is no broadcast hint: Spark broadcasts the dimension when its size, from the
    file statistics or measured at run time, is under
    ``spark.sql.autoBroadcastJoinThreshold``, and otherwise does a sort-merge join in
    which adaptive execution splits hot keys on the left side.
    """
    narrow = dimension.select(
        F.col(dimension_key).alias(key), *[F.col(old).alias(new) for new, old in columns.items()]
    )
    return df.join(narrow, key, "left")
