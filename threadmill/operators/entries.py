"""Typed entries of message streams, and those derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("user", "assistant", "tool", "thinking", "todo", "compaction", "questions")
DERIVED = ("todo", "compaction", "questions")


def typed_entries(messages: DataFrame, include_injected: bool = False) -> DataFrame:
    """User, assistant and tool messages; one with thinking adds a `thinking` entry after it.  idx is dense per session."""
    rows = messages.filter(F.col("role").isin("user", "assistant", "tool"))
    rows = rows if include_injected else rows.filter(~F.col("injected"))
    record = F.to_json(F.struct("role", "content", "tool_calls_summary", "timestamp", "injected"))
    base = F.struct(F.col("role").alias("entry_type"), record.alias("record"))
    thought = F.when(F.coalesce("thinking", F.lit("")) != "", F.struct(F.lit("thinking").alias("entry_type"), F.to_json(F.struct("role", "thinking", "timestamp")).alias("record")))
    flat = rows.select("session_id", "seq", "timestamp", F.posexplode(F.array_compact(F.array(base, thought))).alias("sub", "e"))
    return flat.select("session_id", F.row_number().over(W.partitionBy("session_id").orderBy("seq", "sub")).cast("long").alias("n"), "timestamp", "e.*").select("session_id", (F.col("n") - 1).alias("idx"), "entry_type", "timestamp", "record")


def check_kinds(kinds: list[str]) -> list[str]:
    """The wanted kinds; `all` or none means all of them, an unknown one raises."""
    if not kinds or "all" in kinds:
        return list(KINDS)
    if unknown := [k for k in kinds if k not in KINDS]:
        raise ValueError(f"unknown entry type {unknown[0]!r}; known: {', '.join(KINDS)}, all")
    return kinds


def with_derived(entries: DataFrame, derived: dict[str, DataFrame]) -> DataFrame:
    """Derived entries (session_id, n, timestamp, record) behind the typed ones, in the order of DERIVED; idx stays dense."""
    parts = [entries.select("session_id", F.lit(0).alias("part"), F.col("idx").alias("n"), "entry_type", "timestamp", "record")]
    parts += [derived[k].select("session_id", F.lit(i + 1).alias("part"), F.col("n").cast("long").alias("n"), F.lit(k).alias("entry_type"), "timestamp", "record") for i, k in enumerate(DERIVED) if k in derived]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = W.partitionBy("session_id").orderBy("part", "n")
    return out.select("session_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "entry_type", "timestamp", "record")


def of_kinds(entries: DataFrame, kinds: list[str]) -> DataFrame:
    return entries.filter(F.col("entry_type").isin(check_kinds(kinds)))
