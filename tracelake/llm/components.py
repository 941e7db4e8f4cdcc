"""Connected components of a table of edges, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Each round takes the least label among a node and its neighbours, then the
    label of that label; it ends when no label has changed. Rounds are written
    to the shared folder, so lineage stays short and a lost executor costs one
    round. Aggregates combine before they shuffle, so a node with very many
    neighbours is no hot key. An empty table gives an empty result.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "m").alias("c"), F.col("component").alias("was"))
        far = labels.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        step = stored(least.join(far, "c", "left").select("node", F.least("c", "cc").alias("component"), "was"), "labels")
        changed = step.where("component <> was").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
