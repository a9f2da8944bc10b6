"""Connected components by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node of it) for every node of the edges (a, b).

    Each round a node takes the least label among itself and its neighbours, then the
    label of that label, so that rounds grow with the logarithm of the longest path. The
    least over a node's neighbours is taken before rows move, also for a hub.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a != b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), "label")
        near = both.join(of, "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        spread = spread.join(jump, "label").select(
            "node", "before", F.least("label", "further").alias("label")
        )
        spread = stored(spread, "labels")
        changed = spread.where("label != before").limit(1).count()
        labels = spread.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
