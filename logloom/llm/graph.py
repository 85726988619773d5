"""Connected components of a link table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gathered


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: (a, b) long. Returns (node, label) for every node that a link names; label: the smallest
    node of its component. Each round takes the smallest label next door and then the label's label, so
    rounds grow with the logarithm of the longest shortest path. Every round is written to the shared folder."""
    both = gathered(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    )
    labels = gathered(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = least.join(up, "label").select("node", F.least("label", "up").alias("label"), (F.col("was") != F.least("label", "up")).alias("moved"))
        following = gathered(jumped)
        done = following.where("moved").isEmpty()
        discard(labels)
        labels = following
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    discard(both)
    return labels.select("node", "label")
