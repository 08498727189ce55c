"""Summary ledger: counts of slices, coverage, validity; compaction footers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.functions.text import estimate_tokens


def slice_counts(messages: DataFrame) -> DataFrame:
    """Per session: turns by role, with thinking, characters and estimated tokens (each field's bytes / 4, floored)."""
    role, content, thinking = F.col("role"), F.coalesce("content", F.lit("")), F.coalesce("thinking", F.lit(""))
    return messages.groupBy("session_id").agg(
        F.count_if(role == "user").alias("user"), F.count_if(role == "assistant").alias("assistant"), F.count_if(role == "tool").alias("tool"), F.count_if(thinking != "").alias("thinking"),
        F.sum(F.length(content) + F.length(thinking)).alias("chars"), F.sum(estimate_tokens(content) + estimate_tokens(thinking)).alias("tokens_est"),
    )


def valid_ledger(ledger: DataFrame) -> DataFrame:
    """A session's blocks, or none of them if any is malformed (a null column, or to_id before from_id)."""
    bad = F.greatest(*(F.col(c).isNull().cast("int") for c in ledger.columns if c not in ("from_ts", "to_ts"))) == 1
    voided = ledger.filter(bad | (F.col("to_id") < F.col("from_id"))).select("session_id").distinct()
    return ledger.join(voided, "session_id", "left_anti")


def status(ledger: DataFrame, messages: DataFrame) -> DataFrame:
    """Per session: blocks, the id covered through, the id expected next, and counts of the messages behind it.  Ids are
    1-based places in the stream."""
    through = valid_ledger(ledger).groupBy("session_id").agg(F.count("*").alias("blocks"), F.max("to_id").alias("through_id"))
    ids = messages.withColumn("id", F.row_number().over(W.partitionBy("session_id").orderBy("seq")))
    open_ = ids.join(through, "session_id", "left").filter(F.col("id") > F.coalesce("through_id", F.lit(0)))
    tail = slice_counts(open_).withColumnsRenamed({c: f"tail_{c}" for c in ("user", "assistant", "tool", "thinking", "chars", "tokens_est")})
    known = messages.select("session_id").distinct().join(through, "session_id", "left").join(tail, "session_id", "left")
    fill = {c: F.coalesce(c, F.lit(0)) for c in tail.columns[1:]} | {"blocks": F.coalesce("blocks", F.lit(0)), "through_id": F.coalesce("through_id", F.lit(0))}
    return known.withColumns(fill).withColumn("expected_from_id", F.col("through_id") + 1)


def since_stamp(messages: DataFrame, to_ts: str) -> DataFrame:
    return messages.filter(F.col("timestamp") > to_ts)


def summarise(messages: DataFrame, ledger: DataFrame, from_id: int, summarizer: Callable[[str, str], str]) -> dict[str, object]:
    """A new block for one session's messages from `from_id` on: it must be the id expected next.  The summarizer is
    called on the driver with an instruction and the bounded prompt."""
    from threadmill.plans.prompts import bounded_prompt

    row = status(ledger, messages).first()
    if row is None or row["expected_from_id"] != from_id:
        raise ValueError(f"from_id must be {row['expected_from_id'] if row else 1}")
    ids = messages.withColumn("id", F.row_number().over(W.partitionBy("session_id").orderBy("seq"))).filter(F.col("id") >= from_id)
    prompt = bounded_prompt(ids).first()
    last = ids.agg(F.max("id").alias("to_id"), F.min_by("timestamp", "id").alias("from_ts"), F.max_by("timestamp", "id").alias("to_ts")).first()
    return {"session_id": row["session_id"], "from_id": from_id, **last.asDict(), "text": summarizer("Summarise this part of the session.", prompt["text"] if prompt else "")}


def delete_latest(ledger: DataFrame) -> DataFrame:
    """The ledger without each session's last block."""
    last = ledger.groupBy("session_id").agg(F.max("to_id").alias("to_id"))
    return ledger.join(last, ["session_id", "to_id"], "left_anti")


def compaction_footer(rows: DataFrame, marker: F.Column, keep: int = 3, key: str = "session_id", seq: str = "seq", content: str = "content") -> DataFrame:
    """For each session's last `keep` markers: messages and lines after it, and how many markers are held back.  An
    ending newline begins no line."""
    text = F.coalesce(content, F.lit(""))
    lines = F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0))
    later = W.partitionBy(key).orderBy(F.desc(seq)).rowsBetween(W.unboundedPreceding, -1)
    seen = rows.select(key, seq, marker.alias("is_marker"), lines.alias("n_lines")).withColumns({"messages_since": F.count("*").over(later), "lines_since": F.coalesce(F.sum("n_lines").over(later), F.lit(0))})
    ranked = seen.filter("is_marker").withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seq))))
    total = rows.filter(marker).groupBy(key).agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("held_back"))
    return ranked.filter(F.col("nth") <= keep).join(total, key).select(key, seq, "messages_since", "lines_since", "held_back")
