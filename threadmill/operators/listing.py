"""Session listings: counts, windows, children, bounded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTING_ROWS, ID_ROWS = 200, 10


def message_counts(messages: DataFrame, marker: Column) -> DataFrame:
    """Per session: rows, bytes, turns by role, whether a marker occurs.  One aggregate, combined before the shuffle."""
    role = F.col("role")
    return messages.groupBy("session_id").agg(
        F.count("*").alias("line_count"), F.sum(F.octet_length(F.coalesce("content", F.lit("")))).alias("file_size"), F.count_if(role == "user").alias("user_count"),
        F.count_if(role == "assistant").alias("assistant_count"), F.count_if(role == "tool").alias("tool_count"), F.bool_or(marker).alias("has_compaction"),
    )


def window_sessions(sessions: DataFrame, updated: str, cutoff: Column | None = None, cap: int = LISTING_ROWS) -> tuple[DataFrame, DataFrame]:
    """The `cap` most recent sessions of a window, and the window's whole count."""
    seen = sessions if cutoff is None else sessions.filter(F.col(updated) >= cutoff)
    return seen.orderBy(F.desc(updated), "session_id").limit(cap), seen.agg(F.count("*").alias("window_count"))


def scoped_counts(window: DataFrame, parts: DataFrame, key: str = "session_id") -> DataFrame:
    """Counts of `parts` for the sessions of a window alone.  The window has LISTING_ROWS rows at most, so it is
    broadcast, and parts are cut to it before they are aggregated."""
    small = F.broadcast(window.select(key))
    return parts.join(small, key, "left_semi").groupBy(key).agg(F.count("*").alias("parts"))


def with_counts(sessions: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    """Left join with 0 for sessions without rows."""
    return sessions.join(counts, "session_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in columns})


def children(sessions: DataFrame, parent: str, child: str, updated: str, keep: int | None = None) -> DataFrame:
    """(parent, child_ids most recent first, n_children).  With `keep`, each task holds that many ids per parent at most."""
    from pyspark.sql import Window as W

    have = sessions.filter(F.col(parent).isNotNull())
    counts = have.groupBy(parent).agg(F.count("*").alias("n_children"))
    if keep is not None:
        have = have.withColumn("__n", F.row_number().over(W.partitionBy(parent).orderBy(F.desc(updated), child))).filter(F.col("__n") <= keep)
    else:
        have = have.withColumn("__n", F.row_number().over(W.partitionBy(parent).orderBy(F.desc(updated), child)))
    ids = have.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col(child).alias("id")))), lambda x: x["id"]).alias("child_ids"))
    return counts.join(ids, parent)


def listing_row(sessions: DataFrame, keep: int = ID_ROWS) -> DataFrame:
    """Id lists cut to `keep` with their true counts, and a notice where something was cut."""
    n, m = F.size("child_sessions"), F.size("aliases")
    note = F.when((n > keep) | (m > keep), F.concat(F.lit("id lists cut to "), F.lit(str(keep)), F.lit(" entries; the counts are whole")))
    return sessions.withColumns({"child_session_count": n, "alias_count": m, "notice": note, "child_sessions": F.slice("child_sessions", 1, keep), "aliases": F.slice("aliases", 1, keep)})


def annotate(sessions: DataFrame, indexed: DataFrame, ledger: DataFrame) -> DataFrame:
    """has_index and the id that the summary ledger covers, both by left join."""
    flags = indexed.select("session_id").distinct().withColumn("has_index", F.lit(True))
    through = ledger.groupBy("session_id").agg(F.max("to_id").alias("cached_through"))
    return sessions.join(flags, "session_id", "left").join(through, "session_id", "left").withColumn("has_index", F.coalesce("has_index", F.lit(False)))


def rollouts_table(sessions: DataFrame, current: str | None = None) -> DataFrame:
    """(ord, line) of a markdown table of sessions, most recent first."""
    from pyspark.sql import Window as W

    from threadmill.functions.text import size_label

    mark = F.when(F.contains(F.col("session_id"), F.lit(current)), "**SUMMARISED**").otherwise("") if current else F.lit("")
    top = sessions.orderBy(F.desc("end_time"), "session_id").limit(LISTING_ROWS)
    line = F.concat_ws(" | ", F.lit("").cast("string"), "session_id", "end_time", size_label("file_size"), F.col("line_count").cast("string"), mark)
    return top.select(F.row_number().over(W.orderBy(F.desc("end_time"), "session_id")).alias("ord"), F.concat(F.trim(line), F.lit(" |")).alias("line"))
