"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import held


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label): label is the least node of the component, for the nodes of links (a, b).

    Each round gives every node the least label among its neighbours and then its label's label, so chains
    shorten by halves; the tables stay distributed and their lineage is cut each round. With `rounds`, it stops
    after so many: nodes of one label are then of one component, but a component may have several labels.
    """
    both = held(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = held(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    done = 0
    while True:
        told = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        own = labels.select("node", "label", F.col("label").alias("was"))
        least = own.unionByName(told).groupBy("node").agg(F.min("label").alias("label"), F.min("was").alias("was"))
        up = labels.select(F.col("node").alias("of"), F.col("label").alias("above"))
        new = held(least.join(up, F.col("label") == F.col("of"), "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"), "was"))
        labels, done = new.select("node", "label"), done + 1
        if done == rounds or not new.filter(F.col("label") != F.col("was")).take(1):
            return labels
