"""How stored tables are laid out, and what a reader skips by that."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ridelens import sinks


def _rows_read(spark, df) -> int:
    """Rows that came out of the scan, before the filter above it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    routes = spark.range(0, 40_000, numPartitions=1).select(
        F.col("id").alias("start_station_id"), F.when(F.col("id") == 31_234, 7).otherwise(F.col("id") % 9_000 * 2).alias("end_station_id")
    )
    read = {}
    for name, bloom in (("with", ("end_station_id",)), ("without", ())):
        path = str(tmp_path / name)
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1000")
        with_blocks = routes.sortWithinPartitions("start_station_id")
        options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom}
        with_blocks.write.options(**options).option("parquet.block.size", "20000").option("parquet.page.size", "2000").option("parquet.enable.dictionary", "false").parquet(path)
        assert pq.ParquetFile(next(Path(path).glob("*.parquet"))).num_row_groups > 3
        found = spark.read.parquet(path).where("end_station_id = 7")
        read[name] = _rows_read(spark, found)
        assert found.count() == 1
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    assert read["with"] < read["without"] / 2


def test_route_table_has_bloom_filters_by_its_other_end(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("start_station_id"), F.col("id").alias("end_station_id"), F.lit(1).alias("trip_count")).write.parquet(str(tmp_path / "a"))
    sinks.write_table(spark.read.parquet(str(tmp_path / "a")), str(tmp_path / "b"), sinks.LAYOUT["station_routes"], bloom=sinks.BLOOM["station_routes"])
    sizes = [sum(p.stat().st_size for p in (tmp_path / n).glob("*.parquet")) for n in ("a", "b")]
    assert sizes[1] > sizes[0]


def test_months_are_ordered_by_start(spark, tmp_path):
    rides = spark.range(0, 3000, numPartitions=6).select(
        F.timestamp_seconds(F.pmod(F.hash("id"), F.lit(2_000_000))).cast("timestamp_ntz").alias("started_at"), "id"
    )
    rides = rides.withColumns({"year": F.year("started_at"), "month": F.month("started_at")})
    sinks.write_trips(rides, str(tmp_path))
    files = list(tmp_path.glob("year=1970/month=1/*.parquet"))
    assert len(files) == 1
    starts = pq.read_table(files[0]).column("started_at").to_pylist()
    assert starts == sorted(starts) and spark.read.parquet(str(tmp_path)).count() == 3000
