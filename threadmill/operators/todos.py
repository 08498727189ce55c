"""Todo lists: change events between snapshots, opened and closed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.functions.text import item_key

TERMINAL = ("completed", "cancelled", "removed")


def todo_events(flushes: DataFrame) -> DataFrame:
    """Changes between consecutive snapshots (session_id, flush, timestamp, todos): per item in its order `added`, its new
    status, or `updated`; then `removed` for items of the snapshot before that are gone, in that one's order.

    Items meet by key; of several with a key, the earlier snapshot's first counts.  flush numbers need not be dense."""
    order = W.partitionBy("session_id").orderBy("flush")
    numbered = flushes.withColumn("nth", F.row_number().over(order))
    items = numbered.select("session_id", "nth", "timestamp", F.posexplode("todos").alias("pos", "t")).select("session_id", "nth", "timestamp", "pos", F.col("t.content").alias("content"), F.coalesce("t.status", F.lit("")).alias("status")).withColumn("key", item_key("content"))
    before = items.groupBy("session_id", (F.col("nth") + 1).alias("nth"), "key").agg(F.min_by(F.struct("content", "status"), "pos").alias("was"))
    ts = F.coalesce("timestamp", F.lit("0"))
    met = items.join(before, ["session_id", "nth", "key"], "left")
    action = F.when(F.col("was").isNull(), "added").when(F.col("was.status") != F.col("status"), F.col("status")).when(F.col("was.content") != F.col("content"), "updated")
    changed = met.withColumn("action", action).filter("action is not null").select("session_id", "nth", F.lit(0).alias("phase"), "pos", ts.alias("ts"), "action", F.col("content").alias("todo"), F.col("status").alias("status"))
    later = numbered.select("session_id", "nth", F.col("timestamp").alias("later_ts"))
    gone = items.withColumn("nth", F.col("nth") + 1).join(later, ["session_id", "nth"]).join(items.select("session_id", "nth", "key").distinct(), ["session_id", "nth", "key"], "left_anti")
    removed = gone.select("session_id", "nth", F.lit(1).alias("phase"), "pos", F.coalesce("later_ts", F.lit("0")).alias("ts"), F.lit("removed").alias("action"), F.col("content").alias("todo"), F.lit(None).cast("string").alias("status"))
    return changed.unionByName(removed)


def churn(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """opened and closed per session: items added less the restated baseline (session_id, baseline), never below 0, and
    items that reached a final state; churning if more were opened than closed."""
    counts = events.groupBy("session_id").agg(F.count_if(F.col("action") == "added").alias("added"), F.count_if(F.col("action").isin(*TERMINAL)).alias("closed"))
    opened = F.greatest(F.lit(0), F.col("added") - F.coalesce("baseline", F.lit(0)))
    return counts.join(baseline, "session_id", "left").select("session_id", opened.alias("opened"), "closed", (opened > F.col("closed")).alias("churning"))


def latest(rows: DataFrame, keep: int, key: str = "session_id", order: Column | str = "seq") -> DataFrame:
    """The last `keep` rows of each session, each with the number held back."""
    w = W.partitionBy(key)
    total = rows.groupBy(key).agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("held_back"))
    kept = rows.withColumn("__n", F.row_number().over(w.orderBy(F.desc(order)))).filter(F.col("__n") <= keep).drop("__n")
    return kept.join(total, key)
