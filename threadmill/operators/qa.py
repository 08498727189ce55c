"""Questions and their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.functions.literals import parse_answers

OPTIONS = "array<struct<label:string,description:string>>"
QUESTIONS = f"struct<questions:array<struct<question:string,header:string,options:{OPTIONS}>>>"
#: Tools whose calls ask questions.
TOOLS = ("question", "ask_user_question")


def parse_questions(args: Column | str) -> Column:
    """Questions of a question call's arguments; those without text are left out, damage gives an empty list."""
    args = F.col(args) if isinstance(args, str) else args
    got = F.filter(F.from_json(args, QUESTIONS)["questions"], lambda q: q["question"].isNotNull())
    option = lambda o: F.struct(o["label"].alias("label"), F.coalesce(o["description"], F.lit("")).alias("description"))
    options = lambda q: F.coalesce(F.transform(F.filter(q["options"], lambda o: o["label"].isNotNull()), option), F.array().cast(OPTIONS))
    shaped = F.transform(got, lambda q: F.struct(q["question"].alias("question"), q["header"].alias("header"), options(q).alias("options")))
    return F.coalesce(shaped, F.array().cast(f"array<struct<question:string,header:string,options:{OPTIONS}>>"))


def next_reply(rows: DataFrame, role: str, content: str = "content", key: str = "session_id", seq: str = "seq") -> Column:
    """Content of the first later row with a role: read from the end, so that each session's frame only grows."""
    later = W.partitionBy(key).orderBy(F.desc(seq)).rowsBetween(W.unboundedPreceding, -1)
    return F.last(F.when(F.col("role") == role, F.col(content)), ignorenulls=True).over(later)


def last_by_call(tools: DataFrame) -> DataFrame:
    """One row per (session_id, call_id): of several results with a call's id, the last counts."""
    kept = [c for c in tools.columns if c not in ("session_id", "call_id")]
    return tools.groupBy("session_id", "call_id").agg(F.max_by(F.struct(*kept), "seq").alias("x")).select("session_id", "call_id", "x.*")


def pair_answers(calls: DataFrame) -> DataFrame:
    """One row per pair of rows with `questions` and `records`: the record that names the question, else the one at its
    place; a question without a record gives none; without questions each record gives one.  A column `nth`, where there is
    one, is kept."""
    keys = ["session_id", "seq", *(["nth"] if "nth" in calls.columns else [])]
    asked = calls.filter(F.size("questions") > 0).select(*keys, "timestamp", "records", F.posexplode("questions").alias("pos", "q"))
    named = F.get(F.filter("records", lambda r: r["question"] == F.col("q.question")), F.lit(0))
    answer = F.coalesce(named, F.get("records", F.col("pos")))
    paired = asked.withColumn("answer", answer).filter("answer is not null").select(*keys, "pos", "q.question", "q.header", "q.options", F.col("answer.answer").alias("answer"), "timestamp")
    alone = calls.filter(F.size("questions") == 0).select(*keys, "timestamp", F.posexplode("records").alias("pos", "r"))
    alone = alone.select(*keys, "pos", F.coalesce("r.question", F.lit("")).alias("question"), F.lit(None).cast("string").alias("header"), F.array().cast(OPTIONS).alias("options"), F.col("r.answer").alias("answer"), "timestamp")
    return paired.unionByName(alone)


def answered(calls: DataFrame) -> DataFrame:
    """Pairs of `calls` (session_id, seq, nth, timestamp, args, reply, records, fallback): `records` if the result states
    them, else those of its text; cancelled and unanswered calls give none.  fallback: the question where none is named."""
    read = calls.withColumn("said", parse_answers("reply")).filter("records is not null or not said.cancelled")
    read = read.withColumn("records", F.coalesce("records", "said.records")).filter(F.size("records") > 0).withColumn("questions", parse_questions("args"))
    named = F.transform("records", lambda r: F.struct(F.coalesce(r["question"], F.col("fallback")).alias("question"), r["answer"].alias("answer")))
    return pair_answers(read.withColumn("records", F.when(F.size("questions") == 0, named).otherwise(F.col("records"))))


def pairs_of_messages(messages: DataFrame) -> DataFrame:
    """Question pairs of normalized streams: an assistant's call line of a question tool and the next tool message."""
    calls = messages.withColumn("reply", next_reply(messages, "tool")).filter("role = 'assistant' and reply is not null")
    flat = calls.select("session_id", "seq", "timestamp", "reply", F.posexplode("tool_calls_summary").alias("nth", "line"))
    asked = flat.filter(" or ".join(f"startswith(line, '{t}(')" for t in TOOLS))
    args = F.regexp_replace(F.regexp_extract("line", r"(?s)^[^(]*\((.*)$", 1), r"\)$", "")
    return answered(asked.select("session_id", "seq", "nth", "timestamp", args.alias("args"), "reply", F.lit(None).cast("array<struct<question:string,answer:string>>").alias("records"), F.col("line").alias("fallback")))


def pairs_by_call(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Question pairs of stores that give calls an id: `calls` (session_id, seq, nth, call_id, timestamp, args) meet
    `results` (session_id, seq, call_id, timestamp, reply, records)."""
    last = last_by_call(results).withColumnsRenamed({"timestamp": "answered_at"}).drop("seq")
    met = calls.join(last, ["session_id", "call_id"]).withColumn("timestamp", F.coalesce("answered_at", "timestamp"))
    return answered(met.withColumn("fallback", F.lit(None).cast("string")))


def as_entries(pairs: DataFrame) -> DataFrame:
    """(session_id, n, timestamp, record) of question pairs, in their order."""
    order = W.partitionBy("session_id").orderBy("seq", "nth", "pos")
    return pairs.select("session_id", F.row_number().over(order).alias("n"), "timestamp", F.to_json(F.struct("question", "header", "options", F.array("answer").alias("answers"), "timestamp")).alias("record"))


def joined_answers(answers: Column) -> Column:
    """The answers of a multiple choice as one text."""
    return F.array_join(answers, "; ")
