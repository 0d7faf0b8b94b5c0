"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of links (a, b): the label is the least node that can be reached.

    In a round each node takes the least label around it; the node that was
    its label takes it too, so that whole trees are hung below others; then
    every node goes on to its label's label.  Trees at least double, so rounds
    grow with the logarithm of the longest path.  State is checkpointed after
    each round (reliable checkpoint), and no node's links are gathered.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct().checkpoint()
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        hung = step.groupBy(F.col("label").alias("root")).agg(F.min("new").alias("low"))
        step = (step.join(hung, step["node"] == hung["root"], "left")
                .select("node", F.col("label").alias("was"), F.least("new", F.coalesce("low", "new")).alias("label")).checkpoint())
        further = step.select(F.col("node").alias("at"), F.col("label").alias("next"))
        state = step.join(further, step["label"] == further["at"], "left").select("node", "was", F.coalesce("next", "label").alias("label")).checkpoint()
        labels = state.select("node", "label")
        if state.filter("label <> was").isEmpty():
            return labels
