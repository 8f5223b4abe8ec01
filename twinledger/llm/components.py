"""Connected components of a link table, by least-neighbour labels with pointer jumping; nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import kept_table


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): the least id that can be reached. Null ends and self-links are ignored.

    Each round every id takes the least label among its own and its neighbours', then the label of its label. The
    reached distance at least doubles a round once labels meet, so the rounds follow the logarithm of the longest
    shortest path. Aggregates combine before they shuffle, so a hub of many links is no hot task.
    """
    pairs = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = kept_table(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = kept_table(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select(
            "id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        after = kept_table(lower.join(jump, "component", "left").select(
            "id", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        labels = after.select("id", "component")
        if after.filter("old <> component").isEmpty():
            return labels
