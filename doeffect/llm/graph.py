"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the least node reachable from each node that has an edge.

    Every round takes the least label among a node and its neighbours, then
    the label of that label; rounds grow with the logarithm of the longest
    chain, and each is checkpointed.  Labels are combined before the shuffle,
    so a node with very many neighbours is no hot spot.  NULL ends are
    dropped; no edges give no rows.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    ends = [F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in ((a, b), (b, a))]
    both = (
        edges.select(F.inline(F.array(*ends)))
        .where(F.col("node").isNotNull() & F.col("other").isNotNull())
        .distinct()
        .checkpoint()
    )
    labels = both.groupBy("node").agg(F.min("other").alias("other")).select(
        "node", F.least("node", "other").alias("component")
    )
    while True:
        told = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(
            F.min("component").alias("near")
        )
        step = labels.join(told, "node", "left").select("node", "component", F.least("component", "near").alias("near"))
        up = step.select(F.col("node").alias("near"), F.col("near").alias("far"))
        labels_new = (
            step.join(up, "near", "left")
            .select("node", F.least("near", "far").alias("component"), (F.least("near", "far") != F.col("component")).alias("changed"))
            .checkpoint()
        )
        labels = labels_new.select("node", "component")
        if not labels_new.where("changed").limit(1).count():
            return labels
