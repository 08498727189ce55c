"""Aliases of one session, and the merge of live and snapshot records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.functions.text import same_turn, stamp_digits


def aliases(sessions: DataFrame, keys: list[str], distance: str, id_col: str = "session_id") -> DataFrame:
    """One row per group of equal `keys`: the member nearest by `distance` (ties by id) and the other ids, ascending.

    A hash aggregate, so a very large group is combined before the shuffle instead of being sorted in one task."""
    best = F.min(F.struct(F.coalesce(distance, F.lit(2**63 - 1)).alias("d"), F.col(id_col).alias("id")))
    grouped = sessions.groupBy(*keys).agg(best.alias("best"), F.collect_set(id_col).alias("ids"))
    return grouped.select(*keys, F.col("best.id").alias(id_col), F.array_sort(F.array_except("ids", F.array("best.id"))).alias("aliases"))


def name_distance(folder: str = "folder", start: str = "start_time"):
    """How far the digits of a session folder's name are from those of its start time."""
    return F.abs(stamp_digits(folder) - stamp_digits(start))


def merge_chunks(records: DataFrame) -> DataFrame:
    """records (session_id, source, id, role, content, sort_key, path, pos): live records once per id; of snapshot
    records (`history`, `injection`) user turns once per content, unless a live user turn says the same; by sort_key."""
    live = records.filter(~F.col("source").isin("history", "injection"))
    by_id = W.partitionBy("session_id", "id").orderBy("path", "pos")
    live = live.withColumn("__n", F.when(F.col("id").isNull(), 1).otherwise(F.row_number().over(by_id))).filter("__n = 1").drop("__n")
    by_text = W.partitionBy("session_id", "content").orderBy("path", "pos")
    snap = records.filter(F.col("source").isin("history", "injection") & (F.col("role") == "user")).withColumn("__n", F.row_number().over(by_text)).filter("__n = 1").drop("__n")
    said = live.filter("role = 'user'").select(F.col("session_id").alias("s"), F.col("content").alias("live"))
    only = snap.join(said, (F.col("session_id") == F.col("s")) & same_turn("content", "live"), "left_anti")
    both = live.withColumn("part", F.lit(0)).unionByName(only.withColumn("part", F.lit(1)))
    order = W.partitionBy("session_id").orderBy("sort_key", "part", "path", "pos")
    return both.withColumn("seq", F.row_number().over(order) - 1).drop("part")
