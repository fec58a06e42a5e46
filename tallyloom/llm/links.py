"""Connected components of links that stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import keep


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label`` (the smallest node that can be reached) of every node of ``links``.

    Each round a node takes the smallest label around it and then that label's own label, so the
    number of rounds grows with the logarithm of a chain's length. Every round is written to the
    shared folder; a round only moves counts, minima and joins on single nodes.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = keep(both.union(both.select("v", "u")).distinct(), "links")
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"))
    labels = keep(labels.select(F.col("u").alias("node"), "label"), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("above"))
        step = keep(low.join(up, "low").select("node", F.col("above").alias("label"), (F.col("above") != F.col("label")).alias("moved")), "labels")
        labels = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return labels
