"""Session settings the plans are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Rides carry wall-clock times without a zone, so the session zone only has to be
# fixed, not local.  The adaptive settings let Spark size shuffle partitions, split
# hot join keys and turn joins with small measured sides into broadcasts.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "ridelens", master: str | None = None, **conf) -> SparkSession:
    """A session with SETTINGS; keyword arguments use ``__`` for dots and win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that only this run needs, where all machines can see it.

    It lies in the shared folder that the session names. Only a session that runs on one
    machine may do without one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(shared)
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared}/{name}-{uuid.uuid4().hex}"
