"""Filters, slices and pages over message streams of many sessions at once."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARKER = "context compaction"


def is_marker(style: str = "contains") -> Column:
    """Compaction marker: content holds the phrase (`contains`), injected and holds it (`injected`), or injected and equals it (`equals`)."""
    held = F.contains(F.col("content"), F.lit(MARKER))
    return {"contains": held, "injected": F.col("injected") & held, "equals": F.col("injected") & (F.col("content") == MARKER)}[style]


def user_messages(messages: DataFrame) -> DataFrame:
    return messages.filter((F.col("role") == "user") & ~F.col("injected"))


def visible(messages: DataFrame, include_injected: bool = False) -> DataFrame:
    return messages if include_injected else messages.filter(~F.col("injected"))


def since_last_marker(rows: DataFrame, marker: Column, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """Rows from each session's last marker on, the marker included; sessions without one keep all rows.

    The markers' places are aggregated per session before they meet the rows, so no session is sorted."""
    last = rows.filter(marker).groupBy(key).agg(F.max(seq).alias("__last"))
    return rows.join(last, key, "left").filter(F.col("__last").isNull() | (F.col(seq) >= F.col("__last"))).drop("__last")


def page(rows: DataFrame, limit: int, offset: int | None = None, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """`limit` rows of each session from `offset` on, or its last ones."""
    w = W.partitionBy(key)
    if offset is None:
        return rows.withColumn("__n", F.row_number().over(w.orderBy(F.desc(seq)))).filter(F.col("__n") <= limit).drop("__n")
    ranked = rows.withColumn("__n", F.row_number().over(w.orderBy(seq))).filter(F.col("__n") <= offset + limit)
    return ranked.filter(F.col("__n") > offset).drop("__n")


def within_hours(rows: DataFrame, now: Column, hours: int, stamp: str = "mtime") -> DataFrame:
    """0 hours means no bound; an unknown time passes."""
    return rows if hours == 0 else rows.filter(F.col(stamp).isNull() | (F.col(stamp) >= now - F.make_interval(hours=F.lit(hours))))


def within_hours_text(rows: DataFrame, cutoff: str, stamp: str = "end_time") -> DataFrame:
    """Compares ISO stamps as strings; what is no ISO stamp passes."""
    from threadmill.functions.text import is_iso8601

    return rows.filter(~is_iso8601(stamp) | (F.col(stamp) >= cutoff))


def in_directory(sessions: DataFrame, part: str, style: str = "like") -> DataFrame:
    """Directory filter: `like` (ASCII case-insensitive, % and _ are wildcards, null fails), `folded` (lower-cased
    substring, null passes) or `exact` (substring, null passes)."""
    d = F.col("directory")
    if style == "like":  # as a database's LIKE: only A-Z fold, nothing escapes
        folded = lambda c: F.translate(c, ascii_uppercase, ascii_lowercase)
        return sessions.filter(F.like(folded(d), folded(F.lit(f"%{part}%")), F.lit("\x01")))
    return sessions.filter(d.isNull() | (F.contains(F.lower(d), F.lit(part.lower())) if style == "folded" else F.contains(d, F.lit(part))))


def resolve_session(sessions: DataFrame, wanted: str, style: str = "prefix", recent: str = "mtime") -> DataFrame:
    """The one session that an id means: `exact` wins, then by style (`contains`, `prefix`, `shortest`), the most recent first."""
    s = F.col("session_id")
    hit = F.lit(True) if not wanted else s.startswith(wanted) if style == "prefix" else s.contains(wanted)
    order = [F.desc(s == wanted), *([F.length(s)] if style == "shortest" else []), F.desc_nulls_last(recent), "session_id"]
    return sessions.filter(hit).orderBy(*order).limit(1)


def select_sessions(sessions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted (pos, id) met with sessions on substring: the first session in `ord` for each id, each session once in the
    order of the ids; and the ids without one.  The list of ids is typed in by a user, so it is broadcast."""
    met = sessions.join(F.broadcast(wanted), F.contains(F.col("session_id"), F.col("id")))
    first = met.groupBy("pos", "id").agg(F.min_by("session_id", "ord").alias("session_id"))
    chosen = first.groupBy("session_id").agg(F.min("pos").alias("pos"))
    return chosen, wanted.join(F.broadcast(first.select("id")), "id", "left_anti")
