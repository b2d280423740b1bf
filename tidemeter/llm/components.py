"""Connected components by smallest label, with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.common import settle


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """``(node, label)`` for every node of the ``(a, b)`` links; the label is the component's smallest node.

    No link table leaves the cluster. Rounds grow with the logarithm of a component's diameter.
    """
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), name)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # The label of the label, as it was: what every node points to points further.
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("above"))
        jumped = hooked.join(roots, F.col("label") == F.col("root")).select("node", "old", F.least("label", "above").alias("label"))
        jumped = settle(jumped, name)
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels
