"""Connected components of an edge table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that edges (``a``, ``b``) reach from it.

    Each round takes the smallest label among the neighbours, then the label's
    own label, so that a chain of n nodes needs about log n rounds.  Every round
    is written to the shared folder; only a count of changes reaches the driver.
    """
    both = staged(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(), "edges")
    labels = staged(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        .select("node", F.least("node", "near").alias("label"), F.lit(True).alias("changed")), "labels")
    while labels.filter("changed").limit(1).count():
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        lowered = labels.select("node", "label").join(near, "node").select(
            "node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        labels = staged(
            lowered.join(jump, "low", "left")
            .withColumn("low", F.least("low", F.coalesce("far", "low")))
            .select("node", F.col("low").alias("label"), (F.col("low") != F.col("label")).alias("changed")),
            "labels",
        )
    return labels.select("node", "label")
