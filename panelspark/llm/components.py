"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (x, y); a component is named by its smallest node.

    Each round takes the smallest label among a node and its neighbours and
    then follows labels one step further, so that chains shrink by more than
    half and stars end in two rounds. Labels are written after each round;
    nothing but the number of changes reaches the driver. A node with many
    links is a join key that Spark may split, and its labels are reduced
    before the exchange.
    """
    edges = stored(links.select("x", "y").union(links.select("y", "x")).where("x <> y").distinct())
    labels = stored(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("near")).select(
        "node", F.least("node", "near").alias("component")))
    while True:
        near = edges.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("near"))
        step = stored(labels.join(near, F.col("node") == F.col("x")).select(
            "node", "component", F.least("component", "near").alias("next")))
        ahead = step.select(F.col("node").alias("_at"), F.col("next").alias("_ahead"))
        moved = stored(step.join(ahead, F.col("next") == F.col("_at")).select(
            "node", F.least("next", "_ahead").alias("component"),
            (F.least("next", "_ahead") < F.col("component")).alias("changed")))
        labels = moved.select("node", "component")
        if moved.where("changed").limit(1).count() == 0:
            return labels
