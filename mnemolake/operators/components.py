"""Connected components of an undirected edge table, per graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.session import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(graph_id, a, b)`` to ``(graph_id, id, component)``; a component is named by its least id.

    Each round takes the least label among neighbours, then jumps to the label's own label, so long
    chains halve per round. Rounds are checkpointed and stop when no label changes.
    """
    both = checkpointed(
        edges.select("graph_id", F.col("a").alias("id"), F.col("b").alias("near"))
        .unionByName(edges.select("graph_id", F.col("b").alias("id"), F.col("a").alias("near")))
        .distinct()
    )
    labels = checkpointed(
        both.groupBy("graph_id", "id").agg(F.least(F.col("id"), F.min("near")).alias("component"))
    )
    while True:
        around = (
            both.join(labels.select("graph_id", F.col("id").alias("near"), "component"), ["graph_id", "near"])
            .groupBy("graph_id", "id")
            .agg(F.min("component").alias("_near"))
        )
        lower = labels.join(around, ["graph_id", "id"]).select(
            "graph_id", "id", F.col("component").alias("_old"), F.least("component", "_near").alias("component")
        )
        # the label's label as of the last round is already a valid shortcut
        jump = labels.select("graph_id", F.col("id").alias("component"), F.col("component").alias("_far"))
        stepped = checkpointed(
            lower.join(jump, ["graph_id", "component"], "left").select(
                "graph_id", "id", "_old", F.least("component", F.coalesce("_far", "component")).alias("component")
            )
        )
        labels = stepped.drop("_old")
        if stepped.where("_old <> component").isEmpty():
            return labels
