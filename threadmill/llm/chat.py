"""Conversations in a chat template, with the bytes that training should learn from, in Spark expressions alone.

A conversation becomes `<|im_start|>role\\ntext<|im_end|>\\n` for each run of turns of one role; the texts of a run are joined
by `<|im_sep|>`, so they can be told apart again.  Control strings in a text are escaped: the `|` of `<|` gets one more backslash
in front, however many are there already, so no text can open, close or split a turn, and taking one away gives the text back.

Turns are sorted and merged as arrays of structs in segments of `SEGMENT` turn numbers, so that a conversation that holds a
large part of all rows is formatted by many tasks; the segments' strings are then put together, with the role before each
segment from a window over segments.  A conversation's own string has to fit into a row, as any string of Spark's (2 GB).

Nulls: a null role or text is empty, rows with a null conv_id form one conversation, a null turn comes first.  Rows of a conversation
that share their turn are ordered by role and text; repeated rows are turns of their own.  Very long texts are taken whole.
An empty table gives an empty result.  Further columns, whatever their names, are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, BETWEEN, LINE = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|nl|>"
#: Turn numbers of a segment.
SEGMENT = 256
SPANS = "array<struct<start:bigint,length:bigint>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _opened(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("\n"), F.lit(LINE)), F.lit("\n"))


def _runs(turns: Column, starts: Column) -> Column:
    """The turns from each of `starts` to the next as one struct of their role and their escaped texts."""
    return F.transform(starts, lambda s, k: F.struct(F.get(turns, s)["role"].alias("role"), F.transform(F.slice(turns, s + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - s), lambda t: escaped(t["text"])).alias("texts")))


def _spans(runs: Column, learnt: str) -> Column:
    """Where the texts of `learnt` stand in a segment's string, in bytes."""
    gap = lambda r, k, j: F.when(j > 0, len(BETWEEN)).when(k > 0, F.octet_length(_opened(r["role"])) + (len(CLOSE) + 1)).otherwise(0)
    texts = F.flatten(F.transform(runs, lambda r, k: F.transform(r["texts"], lambda x, j: F.struct((r["role"] == learnt).alias("learnt"), gap(r, k, j).cast("long").alias("gap"), F.octet_length(x).cast("long").alias("n")))))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))
    grown = lambda a, t: F.struct((a["at"] + t["gap"] + t["n"]).alias("at"), F.when(t["learnt"], F.array_append(a["spans"], F.struct((a["at"] + t["gap"]).alias("start"), t["n"].alias("length")))).otherwise(a["spans"]).alias("spans"))
    return F.aggregate(texts, none, grown, lambda a: a["spans"])


def format_conversations(turns: DataFrame, learnt: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss) of `turns` (conv_id, turn, role, text).  `loss` holds where the escaped texts of the role
    `learnt` stand in the UTF-8 bytes of `formatted`, one span (start, length) per turn in order."""
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    parts = rows.groupBy("conv_id", F.floor(F.col("turn") / SEGMENT).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    t = F.col("turns")
    parts = parts.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"])))
    parts = parts.withColumn("runs", _runs(t, F.col("starts")))
    runs = F.col("runs")
    body = F.array_join(F.transform(runs, lambda r, k: F.concat(F.when(k > 0, _opened(r["role"])).otherwise(""), F.array_join(r["texts"], BETWEEN))), CLOSE + "\n")
    parts = parts.select("conv_id", "segment", F.get(runs, F.lit(0))["role"].alias("first"), F.element_at(runs, -1)["role"].alias("last"), body.alias("body"), _spans(runs, learnt).alias("spans"))
    order = Window.partitionBy("conv_id").orderBy("segment")
    prev = F.lag("last").over(order)
    head = F.when(prev.isNull(), _opened(F.col("first"))).when(prev == F.col("first"), F.lit(BETWEEN)).otherwise(F.concat(F.lit(CLOSE + "\n"), _opened(F.col("first"))))
    parts = parts.withColumn("head", head).withColumn("size", (F.octet_length("head") + F.octet_length("body")).cast("long"))
    begin = F.sum("size").over(order) - F.octet_length("body")
    parts = parts.withColumn("begin", begin).select("conv_id", F.struct("segment", F.concat("head", "body").alias("piece"), F.transform("spans", lambda s: F.struct((s["start"] + F.col("begin")).alias("start"), s["length"].alias("length"))).alias("spans")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select("conv_id", F.concat(F.array_join(F.col("parts")["piece"], ""), F.lit(CLOSE + "\n")).alias("formatted"), F.flatten(F.col("parts")["spans"]).alias("loss"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, in order."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    shape = r"(?s)^<\|im_start\|>([^\n]*)\n(.*)$"
    role = lambda b: unescaped(F.replace(F.regexp_extract(b, shape, 1), F.lit(LINE), F.lit("\n")))
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(F.regexp_extract(b, shape, 2), r"<\|im_sep\|>"), lambda x: F.struct(role(b).alias("role"), unescaped(x).alias("text")))))


def learnt_texts(encoded: Column, loss: Column) -> Column:
    """The texts under the spans of `loss`, unescaped; `encoded` is the formatted conversation as bytes."""
    inside = lambda s: (s["start"] >= 0) & (s["start"] + s["length"] <= F.octet_length(encoded))
    return F.transform(loss, lambda s: F.when(inside(s), unescaped(F.substring(encoded, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars)."""
    read = formatted.select("conv_id", "formatted", "loss", F.encode("formatted", "utf-8").alias("encoded"), turns_of(F.col("formatted")).alias("turns"))
    read = read.select("conv_id", "turns", F.char_length("formatted").cast("long").alias("formatted_chars"), F.array_join(learnt_texts(F.col("encoded"), F.col("loss")), "").alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")
