"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node each one reaches.

    Every round, each node takes the smallest label among its own and its neighbours', then the
    label of that label (so labels travel twice as far each time); it ends when nothing changes.
    Minima are pre-aggregated before the shuffle, so a node with very many links is no hot spot,
    and each round is written to the shared folder.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "links")
    labels = before = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        offers = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        taken = labels.join(offers, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        moved = stored(taken.join(roots, "label", "left").select("node", "old", F.least("label", "root").alias("label")), "labels")
        done = moved.where("label <> old").isEmpty()
        discard(before, *([edges] if done else []))
        before, labels = moved, moved.select("node", "label")
        if done:
            return labels.withColumnRenamed("label", "component")
