"""Connected components of a graph that stays distributed: least neighbour labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """node and label (least node of its component) of every end of the edges (u, v: long, not null).

    A round takes the least label among neighbours and then the label's own label, so that rounds grow with the
    logarithm of the diameter. Each round's labels are written to the shared folder, which cuts the lineage.
    """
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")))
    total = F.sum(F.col("label").cast("decimal(38,0)")).alias("total")
    before = labels.agg(total).first()["total"]
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.least("label", "near").alias("label"))
        # A label is itself a node, and its own label is at most as large.
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("over"))
        labels = cut(least.join(own, "label").select("node", F.least("label", "over").alias("label")))
        after = labels.agg(total).first()["total"]
        if after == before:
            return labels
        before = after
