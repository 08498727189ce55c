"""Profiles: role counts, first and last stamps, events of interest with their gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.functions.text import first_chars
from threadmill.operators.slicing import is_marker


def role_counts(messages: DataFrame, only: list[str] | None = None) -> DataFrame:
    rows = messages.filter(F.col("role").isin(only)) if only else messages
    return rows.groupBy("session_id", "role").agg(F.count("*").alias("n"))


def role_map(counts: DataFrame) -> DataFrame:
    return counts.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("role_counts"))


def first_last(rows: DataFrame, stamp: str = "timestamp", key: str = "session_id", seq: str = "seq", nulls: bool = False) -> DataFrame:
    """First and last stamp in stream order; with `nulls` those of the first and last row whatever they hold."""
    kept = rows if nulls else rows.filter(F.col(stamp).isNotNull())
    return kept.groupBy(key).agg(F.min_by(stamp, seq).alias("first_ts"), F.max_by(stamp, seq).alias("last_ts"))


def gaps(events: DataFrame, key: str = "session_id", line: str = "line_number", sub: str = "sub") -> DataFrame:
    """Lines since the event before; the first event counts from 0."""
    w = W.partitionBy(key).orderBy(line, sub)
    return events.withColumn("gap_lines", F.col(line) - F.lag(line, 1, 0).over(w))


def _git(summary: Column, kind: str) -> Column:
    return F.contains(summary, F.lit(f"git {kind}"))


def interesting_events(messages: DataFrame, harness: str) -> DataFrame:
    """Events of a store's sessions: compaction first, then the user's message, then tool calls in order, by line."""
    content, calls = F.coalesce("content", F.lit("")), F.coalesce("tool_calls_summary", F.array().cast("array<string>"))
    user = F.col("role") == "user"
    compact = {"mock": is_marker(), "vibe": is_marker(), "opencode": is_marker("injected"), "codex": is_marker("injected"), "pi": F.lit(False)}[harness]
    plain = {"mock": F.lit(False), "vibe": user & ~F.col("injected"), "opencode": user & ~F.col("injected") & (content != ""), "codex": user & ~F.col("injected"), "pi": user}[harness]
    event = lambda when, kind, text: F.when(when, F.struct(kind.alias("event_type") if isinstance(kind, Column) else F.lit(kind).alias("event_type"), text.alias("summary")))
    todo = lambda c: c.startswith("todo(")
    sub = lambda c: F.when(F.contains(c, F.lit("write")), "TodoCreate").when(F.contains(c, F.lit("delete")), "TodoDelete").otherwise("TodoUpdate")
    kinds = ("commit", "push", "tag")
    if harness in ("codex", "pi"):
        of_calls = F.array().cast("array<struct<event_type:string,summary:string>>")
    elif harness == "opencode":
        first = lambda c: F.array_compact(F.array(F.when(_git(c, "commit"), F.struct(F.lit("GitCommit").alias("event_type"), c.alias("summary"))).when(_git(c, "push"), F.struct(F.lit("GitPush").alias("event_type"), c.alias("summary"))).when(_git(c, "tag"), F.struct(F.lit("GitTag").alias("event_type"), c.alias("summary")))))
        of_calls = F.flatten(F.transform(calls, first))
    else:
        git_too = F.lit(harness == "mock")
        every = lambda c: F.array_compact(F.array(event(todo(c), sub(c), c), *(event(_git(c, k) & (~todo(c) | git_too), f"Git{k.capitalize()}", c) for k in kinds)))
        of_calls = F.flatten(F.transform(calls, every))
    lead = F.array_compact(F.array(event(compact, "Compaction", first_chars(content)), event(plain, "UserMessage", first_chars(content))))
    place = F.col("seq") + 1
    if "line" in messages.columns:  # the physical line of stores in files
        place = F.coalesce("line", place)
    flat = messages.select("session_id", place.alias("line_number"), F.posexplode(F.concat(lead, of_calls)).alias("sub", "e")).select("session_id", "line_number", "sub", "e.*")
    return gaps(flat)
