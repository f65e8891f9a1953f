"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard.session import discard, hand_over, release_shuffles


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id reachable, for every id in ``edges`` (``a``, ``b``, longs) to another id.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so labels travel
    twice as far every round. Rounds end when nothing changes; each one's labels are a written table. Every edge is kept
    once and meets the labels of its ends; minima are aggregated map-side, so a node with very many neighbours is no task
    of its own. The result reads a written table, which ``discard`` removes.
    """
    once = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    once = hand_over(once, "edges")
    ends = once.select("a", "b").unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = ends.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("component"))
    labels = hand_over(labels, "labels")
    while True:
        of_a = once.join(labels.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), "component")
        of_b = once.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "component")
        near = of_a.unionByName(of_b).groupBy("id").agg(F.min("component").alias("near"))
        least = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        up = labels.select(F.col("id").alias("next"), F.col("component").alias("up"))
        moved = hand_over(least.join(up, "next").select("id", F.least("next", "up").alias("component"), "old"), "labels")
        changed = moved.filter("component <> old").limit(1).count()
        discard(labels)
        labels = moved
        release_shuffles(edges.sparkSession)
        if not changed:
            discard(once)
            found = labels.select("id", "component")
            found.handed_over = labels.handed_over
            return found
