"""Connected components of a table of links, by repeated exchange of smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for every node of links the smallest node that it is linked with, over any number of steps.

    Each round gives every node the smallest label among its neighbours and then follows that label's own label, so
    chains halve. All sums are map-side combined minima; a node with very many links is split by the skew join. Nodes are
    longs. No links give no rows. Stops when a round changes nothing, whatever the number of rounds.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = saved(both.union(both.select("y", "x")).where("x <> y").distinct())
    labels = saved(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("x"), "left").select("node", F.least("label", "m").alias("next"), F.col("label").alias("old"))
        root = labels.select(F.col("node").alias("r"), F.col("label").alias("root"))
        step = saved(step.join(root, F.col("next") == F.col("r"), "left").select("node", F.least("next", "root").alias("label"), "old"))
        changed = step.where("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
