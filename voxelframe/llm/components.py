"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each linked node's component.

    Least labels spread along the links and are then jumped over
    (label of label), so the number of rounds grows with the logarithm of the
    longest chain.  Each round is a written table; a node with very many links
    is pre-aggregated before the shuffle and its join can be split.
    """
    both = written(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct())
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("label")))
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy(F.col("x").alias("to")).agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("to")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        lower = written(lower)
        jump = lower.select(F.col("node").alias("mid"), F.col("low").alias("jump"))
        moved = lower.join(jump, F.col("low") == F.col("mid"), "left").select("node", "old", F.least("low", F.coalesce("jump", "low")).alias("label"))
        moved = written(moved)
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels
