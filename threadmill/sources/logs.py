"""Readers of session logs in files.  Each yields the normalized message stream of all sessions below a folder, ordered by
`seq`, and (through `damage`) the lines that could not be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.functions.text import iso_from_millis, summarize_tool_call
from threadmill.operators.dedupe import merge_chunks
from threadmill.operators.qa import pairs_by_call
from threadmill.operators.slicing import MARKER, since_last_marker
from threadmill.sources.jsonl import UUID, items, lines, ordered, text_at, texts_of, whole_files

_NONE = "array<string>"


def _no_calls() -> Column:
    return F.array().cast(_NONE)


def mock_messages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per message, already in the normalized shape."""
    return mock_rows(lines(spark, path))


def mock_rows(rows: DataFrame) -> DataFrame:
    """The messages of parsed lines."""
    rec = F.col("rec")
    calls = F.coalesce(F.try_variant_get(rec, "$.tool_calls_summary", "array<string>"), _no_calls())
    rows = rows.filter("rec is not null")
    made = rows.select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session_id"), "line", text_at(rec, "$.role").alias("role"), F.coalesce(text_at(rec, "$.content"), F.lit("")).alias("content"), text_at(rec, "$.thinking").alias("thinking"), calls.alias("tool_calls_summary"), text_at(rec, "$.timestamp").alias("timestamp"), F.coalesce(F.try_variant_get(rec, "$.injected", "boolean"), F.lit(False)).alias("injected"))
    return ordered(made, "line")


def vibe_messages(spark: SparkSession, root: str) -> DataFrame:
    """`session_<date>_<time>_<id>/messages.jsonl` below root; reasoning is not carried over."""
    return vibe_rows(lines(spark, root, "messages.jsonl"))


def vibe_rows(rows: DataFrame) -> DataFrame:
    """The messages of parsed lines."""
    rec = F.col("rec")
    call = lambda c: summarize_tool_call(F.coalesce(text_at(c, "$.function.name"), text_at(c, "$.name"), F.lit("?")), F.coalesce(text_at(c, "$.function.arguments"), F.lit("")))
    rows = rows.filter("rec is not null")
    made = rows.select(F.regexp_extract("path", r"/(session_[^/]+)/messages\.jsonl$", 1).alias("session_id"), "line", F.coalesce(text_at(rec, "$.role"), F.lit("unknown")).alias("role"), F.coalesce(text_at(rec, "$.content"), F.lit("")).alias("content"), F.lit(None).cast("string").alias("thinking"), F.transform(items(rec, "$.tool_calls"), call).alias("tool_calls_summary"), text_at(rec, "$.timestamp").alias("timestamp"), F.coalesce(F.try_variant_get(rec, "$.injected", "boolean"), F.lit(False)).alias("injected"))
    return ordered(made.filter("session_id <> ''"), "line")


def native_entries(rows: DataFrame, full: bool = False, include_injected: bool = False) -> DataFrame:
    """(session_id, idx, entry_type, timestamp, record, line) of parsed lines: each record is its line as it stands in the log, byte for byte.
    Without `full` from each session's last marker on; whether a line is one, its content says whatever its role."""
    rec = F.col("rec")
    rows = rows.filter("rec is not null").select(F.regexp_extract("path", r"/(session_[^/]+)/messages\.jsonl$", 1).alias("session_id"), "line", text_at(rec, "$.role").alias("entry_type"), text_at(rec, "$.timestamp").alias("timestamp"), F.col("raw").alias("record"), F.coalesce(F.try_variant_get(rec, "$.injected", "boolean"), F.lit(False)).alias("injected"), F.contains(F.coalesce(text_at(rec, "$.content"), F.lit("")), F.lit(MARKER)).alias("marks")).filter("session_id <> ''")
    rows = rows if full else since_last_marker(rows, F.col("marks"), seq="line")
    rows = rows.filter(F.col("entry_type").isin("user", "assistant", "tool"))
    rows = rows if include_injected else rows.filter("not injected")
    return rows.select("session_id", (F.row_number().over(W.partitionBy("session_id").orderBy("line")) - 1).cast("long").alias("idx"), "entry_type", "timestamp", "record", "line")


def vibe_question_pairs(rows: DataFrame) -> DataFrame:
    """Question pairs of parsed lines: calls of `ask_user_question` and the tool messages with their ids."""
    rec = F.col("rec")
    rows = rows.filter("rec is not null").select(F.regexp_extract("path", r"/(session_[^/]+)/messages\.jsonl$", 1).alias("session_id"), F.col("line").alias("seq"), text_at(rec, "$.role").alias("role"), text_at(rec, "$.timestamp").alias("timestamp"), "rec").filter("session_id <> ''")
    calls = rows.filter("role = 'assistant'").select("session_id", "seq", "timestamp", F.posexplode(items(rec, "$.tool_calls")).alias("nth", "c"))
    asked = calls.filter(text_at("c", "$.function.name") == "ask_user_question").select("session_id", "seq", "nth", text_at("c", "$.id").alias("call_id"), "timestamp", F.coalesce(text_at("c", "$.function.arguments"), F.lit("")).alias("args")).filter("call_id is not null")
    stated = F.try_variant_get(rec, "$.tool_result.output.answers", "array<variant>")
    record = lambda a: F.struct(text_at(a, "$.question").alias("question"), text_at(a, "$.answer").alias("answer"))
    records = F.filter(F.transform(stated, record), lambda r: r["answer"].isNotNull())
    results = rows.filter("role = 'tool'").select("session_id", "seq", text_at(rec, "$.tool_call_id").alias("call_id"), "timestamp", F.coalesce(text_at(rec, "$.content"), F.lit("")).alias("reply"), records.alias("records")).filter("call_id is not null")
    return pairs_by_call(asked, results)


def vibe_meta(spark: SparkSession, root: str | list[str], only: Column | None = None) -> DataFrame:
    """(session_id, title, start_time, end_time, parent_session_id, directory) from the sessions' meta.json."""
    v, named = F.try_parse_json("text"), r"/([^/]+)/meta\.json$"
    files = whole_files(spark, root, "meta.json", only).select(F.regexp_extract("path", named, 1).alias("session_id"), v.alias("v"))
    return files.select("session_id", text_at("v", "$.title").alias("title"), text_at("v", "$.start_time").alias("start_time"), text_at("v", "$.end_time").alias("end_time"), text_at("v", "$.parent_session_id").alias("parent_session_id"), text_at("v", "$.environment.working_directory").alias("directory"))


def vibe_journal_messages(spark: SparkSession, root: str) -> DataFrame:
    """`unified/<id>/journal/NNNN.jsonl`: core_input is the user's turn, action_result the assistant's; segments by name."""
    return vibe_journal_rows(lines(spark, root, "*.jsonl"))


def vibe_journal_rows(rows: DataFrame) -> DataFrame:
    """The messages of parsed lines."""
    rec, kind = F.col("rec"), text_at("rec", "$.type")
    body = F.coalesce(F.try_variant_get(rec, "$.input", "variant"), rec)
    parts = F.when(F.size(items(rec, "$.parts")) > 0, items(rec, "$.parts")).otherwise(items(body, "$.parts"))
    ms = F.coalesce(F.try_variant_get(rec, "$.input.determinism.time_unix_ms", "long"), F.try_variant_get(rec, "$.determinism.time_unix_ms", "long"))
    rows = rows.filter("rec is not null").withColumn("kind", kind).filter("kind in ('core_input', 'action_result')")
    rows = rows.withColumns({"session_id": F.regexp_extract("path", r"/unified/([^/]+)/journal/", 1), "segment": F.regexp_extract("path", r"/journal/([^/]+)$", 1), "parts": parts})
    call = lambda p: summarize_tool_call(F.coalesce(text_at(p, "$.name"), F.lit("?")), F.coalesce(text_at(p, "$.arguments"), F.to_json(F.try_variant_get(p, "$.arguments", "variant")), F.lit("")))
    calls = F.transform(F.filter("parts", lambda p: F.coalesce(text_at(p, "$.type") == "tool_call", F.lit(False))), call)
    thinking = texts_of(F.col("parts"), ("reasoning",))
    user = F.col("kind") == "core_input"
    made = rows.select("session_id", "segment", "line", F.when(user, "user").otherwise("assistant").alias("role"), texts_of(F.col("parts"), ("text",)).alias("content"), F.when(~user & (thinking != ""), thinking).alias("thinking"), F.when(user, _no_calls()).otherwise(calls).alias("tool_calls_summary"), F.when(user, iso_from_millis(ms, keep_millis=False)).alias("timestamp"), F.lit(False).alias("injected"))
    return ordered(made.filter("session_id <> '' and (role = 'assistant' or content <> '')"), "segment", "line")


def vibe_chunk_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of `unified/<id>/chunks/*.json` (an array or one object a file): session_id, source, id, role, content,
    thinking, tool_calls_summary, timestamp, injected, sort_key, path, pos."""
    return vibe_chunk_rows(whole_files(spark, root, "*.json"))


def _chunk_files(files: DataFrame) -> DataFrame:
    """Whole files of chunk stores with their session and what they hold: null where it is no JSON."""
    return files.filter(F.contains("path", F.lit("/chunks/"))).select("path", "mtime", F.regexp_extract("path", r"/unified/([^/]+)/chunks/", 1).alias("session_id"), F.try_parse_json("text").alias("v"))


def chunk_damage(files: DataFrame) -> DataFrame:
    """(path, line, error) of the chunk files that hold neither a record nor an array of records; the others read on."""
    kind = F.schema_of_variant("v")
    error = F.when(F.col("v").isNull(), "not valid JSON").when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), "neither a record nor an array of records")
    return _chunk_files(files).select("path", F.lit(None).cast("long").alias("line"), error.alias("error")).filter("error is not null")


def unified_layouts(files: DataFrame) -> DataFrame:
    """(session_id, layout, records) of unified sessions, from whole files (path, mtime, text) below `unified/`: `chunks` if their chunks hold a
    record, else `journal` if there is one, else `empty` if there is a chunk file, else `unknown`."""
    session = F.regexp_extract("path", r"/unified/([^/]+)/", 1)
    chunk, journal = F.contains("path", F.lit("/chunks/")) & F.col("path").endswith(".json"), F.contains("path", F.lit("/journal/"))
    v = F.when(chunk, F.try_parse_json("text"))
    kind = F.schema_of_variant(v)
    records = F.when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>"))).when(kind.startswith("OBJECT"), 1).otherwise(0)
    seen = files.select(session.alias("session_id"), chunk.alias("chunk"), journal.alias("journal"), records.alias("n")).filter("session_id <> ''")
    found = seen.groupBy("session_id").agg(F.bool_or("chunk").alias("chunk"), F.bool_or("journal").alias("journal"), F.sum("n").alias("records"))
    layout = F.when(F.col("records") > 0, "chunks").when(F.col("journal"), "journal").when(F.col("chunk"), "empty").otherwise("unknown")
    return found.select("session_id", layout.alias("layout"), "records")


def unified_errors(layouts: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, error) of unified sessions that cannot be read: of no known layout, or with records of which none is a message."""
    met = layouts.join(messages.select("session_id").distinct().withColumn("read", F.lit(True)), "session_id", "left")
    error = F.when(F.col("layout") == "unknown", "unknown layout (neither chunks nor journal is there)").when((F.col("layout") == "chunks") & F.col("read").isNull(), F.format_string("%d chunk records, none of them readable as messages", F.col("records")))
    return met.select("session_id", error.alias("error")).filter("error is not null")


def vibe_chunk_rows(files: DataFrame) -> DataFrame:
    """The records of whole files (path, mtime, text)."""
    files = _chunk_files(files).filter("v is not null")
    rec = F.col("r")
    flat = files.select("session_id", "path", "mtime", F.posexplode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).alias("pos", "r"))
    kind, snapshot = text_at(rec, "$.type"), F.try_variant_get(rec, "$.message", "variant").isNotNull()
    content = F.when(snapshot, texts_of(items(rec, "$.message.content"), ("text",))).when(kind == "message", texts_of(items(rec, "$.content"), ("text",))).when(kind == "effect", texts_of(items(rec, "$.state.output.content"), ("text",))).otherwise("")
    role = F.when(snapshot, text_at(rec, "$.message.role")).when(kind == "message", text_at(rec, "$.role")).when(kind == "reasoning", "assistant").when(kind == "effect", "tool")
    raw = F.try_variant_get(rec, "$.detail.input.raw", "variant")
    args = F.coalesce(text_at(rec, "$.detail.input.raw"), F.to_json(F.coalesce(raw, F.try_variant_get(rec, "$.detail.input", "variant"))), F.lit(""))
    calls = F.when(kind == "effect", F.array(summarize_tool_call(F.coalesce(text_at(rec, "$.detail.toolName"), F.lit("?")), args))).otherwise(_no_calls())
    created = F.coalesce(F.try_variant_get(rec, "$.createdAt", "long"), F.unix_millis(F.try_to_timestamp(text_at(rec, "$.createdAt"))), F.unix_millis("mtime"))
    source = F.coalesce(text_at(rec, "$.source"), F.lit("live"))
    return flat.select("session_id", source.alias("source"), text_at(rec, "$.id").alias("id"), role.alias("role"), content.alias("content"), F.when(kind == "reasoning", text_at(rec, "$.text")).alias("thinking"), calls.alias("tool_calls_summary"), iso_from_millis(created, keep_millis=False).alias("timestamp"), (source == "harness").alias("injected"), created.alias("sort_key"), "path", "pos").filter("role is not null")


def vibe_chunk_messages(spark: SparkSession, root: str) -> DataFrame:
    return ordered(merge_chunks(vibe_chunk_records(spark, root)), "seq")


def codex_messages(spark: SparkSession, root: str) -> DataFrame:
    """`YYYY/MM/DD/rollout-<time>-<id>[_<id>].jsonl`: typed records; developer turns and reasoning are left out."""
    return codex_rows(lines(spark, root, "rollout-*.jsonl"))


def codex_rows(rows: DataFrame) -> DataFrame:
    """The messages of parsed lines."""
    rec, p = F.col("rec"), F.try_variant_get("rec", "$.payload", "variant")
    rows = rows.filter("rec is not null").select(F.regexp_extract("path", rf"-({UUID}(?:_{UUID})?)\.jsonl$", 1).alias("session_id"), "line", text_at(rec, "$.type").alias("kind"), text_at(rec, "$.timestamp").alias("timestamp"), p.alias("p"))
    inner, role = text_at("p", "$.type"), text_at("p", "$.role")
    call, output = inner.isin("custom_tool_call", "function_call"), inner.isin("custom_tool_call_output", "function_call_output")
    said = texts_of(items("p", "$.content"), ("input_text", "output_text"))
    args = F.coalesce(text_at("p", "$.input"), text_at("p", "$.arguments"), F.lit(""))
    result = F.coalesce(text_at("p", "$.output"), F.array_join(F.filter(F.transform(items("p", "$.output"), lambda x: text_at(x, "$.text")), lambda t: t.isNotNull()), "\n"))
    response = F.col("kind") == "response_item"
    kept = F.when(F.col("kind") == "compacted", "system").when(response & (inner == "message") & (role != "developer"), role).when(response & call, "assistant").when(response & output, "tool")
    content = F.when(F.col("kind") == "compacted", MARKER).when(inner == "message", said).when(output, result).otherwise("")
    calls = F.when(call, F.array(summarize_tool_call(F.coalesce(text_at("p", "$.name"), F.lit("?")), args))).otherwise(_no_calls())
    made = rows.select("session_id", "line", kept.alias("role"), content.alias("content"), F.lit(None).cast("string").alias("thinking"), calls.alias("tool_calls_summary"), "timestamp", (F.col("kind") == "compacted").alias("injected"))
    return ordered(made.filter("role is not null and session_id <> ''"), "line")


def pi_messages(spark: SparkSession, root: str) -> DataFrame:
    """`<project>/<time>_<id>.jsonl`: message records of user, assistant and tool results."""
    return pi_rows(lines(spark, root, "*.jsonl"))


def pi_rows(rows: DataFrame) -> DataFrame:
    """The messages of parsed lines."""
    rec, m = F.col("rec"), F.try_variant_get("rec", "$.message", "variant")
    rows = rows.filter("rec is not null").select(F.regexp_extract("path", r"_([^_/]+)\.jsonl$", 1).alias("session_id"), "line", text_at(rec, "$.type").alias("kind"), text_at(rec, "$.timestamp").alias("timestamp"), m.alias("m")).filter("kind = 'message'")
    role = text_at("m", "$.role")
    parts = items("m", "$.content")
    calls = F.transform(F.filter(parts, lambda x: F.coalesce(text_at(x, "$.type") == "toolCall", F.lit(False))), lambda x: summarize_tool_call(F.coalesce(text_at(x, "$.name"), F.lit("?")), F.coalesce(F.to_json(F.try_variant_get(x, "$.arguments", "variant")), F.lit("{}"))))
    thinking = texts_of(parts, ("thinking",), "$.thinking")
    made = rows.select("session_id", "line", F.when(role == "toolResult", "tool").when(role.isin("user", "assistant"), role).alias("role"), F.coalesce(text_at("m", "$.content"), texts_of(parts, ("text",))).alias("content"), F.when(thinking != "", thinking).alias("thinking"), calls.alias("tool_calls_summary"), "timestamp", F.lit(False).alias("injected"))
    return ordered(made.filter("role is not null"), "line")


def first_line_directory(spark: SparkSession, root: str | list[str], glob: str, session: str, only: Column | None = None) -> DataFrame:
    """(session_id, directory): the `cwd` of each session's first record; session: the pattern of the id in its path.  Files that fail
    `only`, a condition on their metadata, are left out unread."""
    rec = F.try_parse_json(F.substring_index("text", "\n", 1))
    cwd = F.coalesce(text_at(rec, "$.payload.cwd"), text_at(rec, "$.cwd"))
    heads = whole_files(spark, root, glob, only).select(F.regexp_extract("path", session, 1).alias("session_id"), "path", cwd.alias("directory"))
    return heads.groupBy("session_id").agg(F.min_by("directory", "path").alias("directory"))


def line_counts(rows: DataFrame, store: str, session: Column) -> DataFrame:
    """Per session, from parsed lines: line_count, turns by role and has_compaction, by the rule of the store.

    A store's rule says whose turn a line is and whether it marks a compaction; lines that are none of these, damaged ones too,
    count as lines, but in the store whose lines are messages."""
    rec, role = F.col("rec"), text_at("rec", "$.role")
    if store == "codex":
        kind, inner, said = text_at(rec, "$.type"), text_at(rec, "$.payload.type"), text_at(rec, "$.payload.role")
        who = F.when(inner == "message", said).when(inner.isin("custom_tool_call", "function_call"), "assistant").when(inner.isin("custom_tool_call_output", "function_call_output"), "tool")
        who, mark = F.when(kind == "response_item", who), kind == "compacted"
    elif store == "pi":
        said = text_at(rec, "$.message.role")
        who, mark = F.when(said == "toolResult", "tool").when(said != "tool", said), F.lit(False)
    else:
        who, mark = role, (role == "user") & F.contains(F.coalesce(text_at(rec, "$.content"), F.lit("")), F.lit(MARKER))
    seen = rows.select(session.alias("session_id"), who.alias("who"), F.coalesce(mark, F.lit(False)).alias("mark"), rec.isNotNull().alias("read")).filter("session_id <> ''")
    count = F.count_if("read") if store == "mock" else F.count("*")
    return seen.groupBy("session_id").agg(count.alias("line_count"), *(F.count_if(F.col("who") == r).alias(f"{r}_count") for r in ("user", "assistant", "tool")), F.bool_or("mark").alias("has_compaction"))


def plan_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of markdown plans below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
