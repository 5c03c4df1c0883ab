"""Connected components of a table of links, by label propagation with pointer jumping, all on Spark.

Every node starts with itself as label. Each turn takes the smallest label among the neighbours, then the label of
that label. Links to a node that very many others link to are combined before they are shuffled, and the join on it
is left to adaptive execution. Labels are written to the shared folder each turn, so a lost executor costs a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in the links (a, b); the component is its smallest node."""
    both = links.select("a", "b").where(F.col("a") != F.col("b"))
    both = stage(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        own = labels.select(F.col("node").alias("b"), F.col("label").alias("_theirs"))
        near = both.join(own, "b").groupBy("a").agg(F.min("_theirs").alias("_near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("_old"), F.least("label", "_near").alias("_low")
        )
        jump = labels.select(F.col("node").alias("_low"), F.col("label").alias("_next"))
        moved = stage(
            lower.join(jump, "_low").select("node", F.least("_low", "_next").alias("label"), "_old"), "labels"
        )
        labels = moved.select("node", "label")
        if not moved.where(F.col("label") != F.col("_old")).limit(1).count():
            return labels.withColumnRenamed("label", "component")
