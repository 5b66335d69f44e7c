"""Connected components of an undirected graph, with durable state between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import durable, unsized


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge the least node that it is connected with.

    Each round gives every node the least label among itself and its neighbours (a partial
    aggregate, so that a hub costs one row per task) and then the label of its label, which
    halves the distance left. Rounds grow with the logarithm of the longest path. Nothing
    reaches the driver but the number of labels that a round changed, and plans stay as small.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = unsized(durable(pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()))
    labels = unsized(durable(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component"))))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        closer = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        of = labels.select(F.col("node").alias("via"), F.col("component").alias("jump"))
        new = unsized(durable(closer.join(of, "via", "left").select("node", "old", F.least("via", "jump").alias("component"))))
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
