"""Connected components of a link table, by aggregations and joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldscape.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for each node of `links` (a, b).

    A round takes the least label among neighbours and then the label of that
    label. Rounds go on until no label changes: along a path whose ids are in order
    labels move twice as far each round; no shape takes more rounds than its longest
    shortest path has links. Sums by node are partial before they are dealt out, and
    the joins are inner or left equi-joins, whose hot partitions Spark splits.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")))
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy("a").agg(F.min("component").alias("low")).withColumnRenamed("a", "node")
        )
        hooked = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "low").alias("via"))
        jumped = written(
            hooked.join(labels.select(F.col("node").alias("via"), F.col("component").alias("far")), "via", "left")
            .select("node", "old", F.least("via", "far").alias("component"))
        )
        labels = jumped.select("node", "component")
        if jumped.where("old <> component").isEmpty():
            return labels
