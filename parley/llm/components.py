"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import cut


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node reachable.

    Every round takes the smallest label among neighbours and then the label of that label, so
    chains shorten by half. Only links and labels are shuffled; each round is checkpointed.
    ``known`` are components of some links; their nodes start from their labels.
    """
    if known is not None:
        links = links.unionByName(known.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("better"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        moved = cut(better.join(jump, F.col("better") == F.col("_n"), "left").select(
            "node", F.least("better", F.coalesce("_l", "better")).alias("label"), F.col("label").alias("was")))
        labels = moved.select("node", "label")
        if not moved.where("label != was").limit(1).count():
            return labels
