"""Connected components by label propagation and pointer jumping, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with root the smallest node that `edges` (a, b) reach from node; only nodes that have an edge.

    Each round gives every node the smallest label among its own and its neighbours', and then the label of that label,
    so known paths double.  Labels only fall, and the rounds end when none changes.  A hub's labels are combined before
    they are shuffled."""
    apart = cut(edges.filter("a <> b").select("a", "b"))  # read four times below, made once
    both = apart.union(apart.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.union(both.select("a", F.col("a").alias("b"))).distinct())
    label = both.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    label = cut(label)
    while True:
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("root"))).alias("was")
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("low"), own)
        jump = near.select(F.col("a").alias("at"), F.col("low").alias("next"))
        new = cut(near.join(jump, near["low"] == jump["at"]).select(F.col("a").alias("node"), F.least("low", "next").alias("root"), (F.least("low", "next") < F.col("was")).alias("fell")))
        label = new.select("node", "root")
        if new.filter("fell").isEmpty():
            return label
