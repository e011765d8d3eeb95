"""Connected components by contraction to smallest neighbours; links never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long, not null). Returns node, label: the smallest node it is linked with, over any number of links.

    Each round points every node at its smallest neighbour or itself, contracts the links to the nodes pointed at,
    and drops those that became loops, so that few remain after a round or two even around hubs. Smallest neighbours
    are found by aggregates, which combine before the shuffle; a hub's links meet its one label in a join that
    adaptive execution may split.
    """
    links = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("into")), "labels")
        if labels is None:
            labels = step.withColumnRenamed("into", "label")
        else:
            labels = labels.join(step, labels.label == step.node, "left").select(labels.node, F.coalesce(step.into, labels.label).alias("label"))
        labels = written(labels, "labels")
        left = links.join(step.select(F.col("node").alias("a"), F.col("into").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("into").alias("y")), "b")
        links = written(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
