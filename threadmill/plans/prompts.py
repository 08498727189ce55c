"""Byte-bounded prompts over sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.functions.text import render_message
from threadmill.operators.budget import tail_budget

BUDGET = 200 * 1024


def bounded_prompt(messages: DataFrame, budget: int = BUDGET, template: str = "{dropped}{messages}") -> DataFrame:
    """Per session: text, bytes, dropped_bytes, dropped_items.  Only messages that can still matter are redacted: a cut
    by raw length, from the newest backwards, goes first (redaction never makes a kept block more than 8 times shorter,
    so 8 budgets are looked at)."""
    raw = F.octet_length(F.coalesce("content", F.lit(""))) + F.coalesce(F.aggregate("tool_calls_summary", F.lit(0), lambda s, x: s + F.octet_length(x)), F.lit(0))
    newest = W.partitionBy("session_id").orderBy(F.desc("seq"))
    far = F.coalesce(F.sum(F.least(raw, F.lit(1600))).over(newest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sized = messages.withColumns({"__raw": raw, "__far": far})
    total = sized.filter("__raw > 0").groupBy("session_id").agg(F.count("*").alias("__items"), F.sum("__raw").alias("__bytes"))
    blocks = sized.filter(F.col("__far") <= 8 * budget).withColumn("block", render_message("role", "content", "tool_calls_summary"))
    kept = tail_budget(blocks, budget, "block")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block"))), lambda x: x["block"]), "\n")
    out = kept.groupBy("session_id").agg(text.alias("kept"), F.count("*").alias("__kept_items"), F.sum("__raw").alias("__kept_bytes"))
    gone = F.col("__items") - F.col("__kept_items")
    note = F.when(gone > 0, F.format_string("[%d older messages left out]\n", gone)).otherwise("")
    whole = F.replace(F.replace(F.lit(template), F.lit("{dropped}"), note), F.lit("{messages}"), F.col("kept"))
    made = out.join(total, "session_id").withColumn("text", whole)
    return made.select("session_id", "text", F.octet_length("text").alias("bytes"), (F.col("__bytes") - F.col("__kept_bytes")).alias("dropped_bytes"), gone.alias("dropped_items"))
