"""Upkeep of stores: pruning, orphans, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prune(events: DataFrame, group: str, seq: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): the `keep` newest rows of each group name the sequence numbers that stay; all rows with another
    number go, whichever group they are in."""
    newest = events.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(F.desc(seq)))).filter(F.col("__n") <= keep)
    numbers = newest.select(seq).distinct()
    return events.join(numbers, seq, "left_semi"), events.join(numbers, seq, "left_anti")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of `child` without their parent."""
    return child.join(parent.select(F.col(pk).alias("__pk")).distinct(), F.col(fk) == F.col("__pk"), "left_anti")


def reconcile(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)
