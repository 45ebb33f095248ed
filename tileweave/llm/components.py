"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tileweave.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``x, y``): the smallest node its links reach.

    Each round takes the smallest label among the neighbours and then the label's own label, so paths shrink
    by half; rounds go on until nothing changes.
    """
    both = cut_lineage(links.where("x <> y").select("x", "y").union(links.where("x <> y").select("y", "x")).toDF("x", "y").distinct())
    labels = cut_lineage(both.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("node"), F.least("x", "low").alias("label")))
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("low"))
        best = labels.join(near, labels["node"] == near["x"]).select("node", F.least("label", "low").alias("label"), F.col("label").alias("before"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        new = cut_lineage(best.join(jump, best["label"] == jump["at"], "left").select("node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "before"))
        if new.where("label <> before").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
