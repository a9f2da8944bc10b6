"""A ride seen from its two stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def by_role(trips: DataFrame, start: dict[str, Column], end: dict[str, Column]) -> DataFrame:
    """Two rows per ride, told apart by ``at_start``, from one scan of the rides.

    A union of two selects would read the rides twice; the copies made here are
    combined again by the partial aggregate in the same task.
    """

    def seen(at_start: bool, columns: dict[str, Column]) -> Column:
        return F.struct(F.lit(at_start).alias("at_start"), *[columns[name].alias(name) for name in start])

    return trips.select(F.inline(F.array(seen(True, start), seen(False, end))))
