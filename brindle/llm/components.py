"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b): the smallest node that links reach.

    Each round first lowers every label to the least label of its neighbours (a
    partial minimum, so a star's centre is no hot group), then follows labels of
    labels.  Rounds end when no label changes; each is written to the shared
    folder.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lowered = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("next"))
        new = lowered.join(jump, "to", "left").select("node", "was", F.least("to", F.coalesce("next", "to")).alias("component"))
        new = materialise(new, "labels")
        changed = new.filter("component <> was").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
