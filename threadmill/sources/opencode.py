"""Message store in SQLite, both layouts: a stream of parts, and the messages that parts make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions.text import iso_from_millis, summarize_tool_call
from threadmill.operators.listing import children, window_sessions
from threadmill.operators.slicing import MARKER
from threadmill.sources.jsonl import items, ordered, text_at
from threadmill.sources.sqlite_source import layout, sqlite_table


def legacy_parts(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, o1, o2, o3, o4, role, part, ms): parts by their message's time, then their own; damaged JSON is skipped."""
    m = sqlite_table(spark, path, "message").select(F.col("id").alias("m_id"), F.col("time_created").alias("o1"), F.try_parse_json("data").alias("m"))
    p = sqlite_table(spark, path, "part").select("session_id", "message_id", F.col("id").alias("o4"), F.col("time_created").alias("o3"), F.try_parse_json("data").alias("part"))
    both = p.join(m, F.col("message_id") == F.col("m_id")).filter("m is not null and part is not null")
    return both.select("session_id", "o1", F.col("m_id").alias("o2"), "o3", "o4", F.coalesce(text_at("m", "$.role"), F.lit("unknown")).alias("role"), "part", F.coalesce(F.try_variant_get("m", "$.time.created", "long"), "o1").alias("ms"))


def v2_parts(spark: SparkSession, path: str) -> DataFrame:
    """The same from inlined parts: a user's text, an assistant's content, compactions, and synthetic texts."""
    t = sqlite_table(spark, path, "session_message").select("session_id", "type", F.col("seq").alias("o1"), F.col("id").alias("o2"), "time_created", F.try_parse_json("data").alias("d")).filter("d is not null")
    kind = F.col("type")
    one = lambda **f: F.array(F.parse_json(F.to_json(F.struct(*(v.alias(k) for k, v in f.items())))))
    text = text_at("d", "$.text")
    parts = F.when(kind == "user", one(type=F.lit("text"), text=text)).when(kind == "assistant", items("d", "$.content")).when(kind == "compaction", one(type=F.lit("compaction"))).when(kind.isin("system", "synthetic"), one(type=F.lit("text"), text=text, synthetic=F.lit(True)))
    flat = t.select("session_id", "o1", "o2", F.posexplode(parts).alias("o3", "part"), F.when(kind.isin("user", "assistant"), kind).otherwise("user").alias("role"), F.col("time_created").alias("ms"))
    return flat.select("session_id", "o1", "o2", "o3", F.lit("").alias("o4"), "role", "part", "ms")


def messages_of(parts: DataFrame) -> DataFrame:
    """text: a message, even an empty one; reasoning: a message of thinking; tool: the call, then its output; compaction:
    the injected marker; synthetic texts, synthetic or empty reasoning and other parts: none."""
    kind, synthetic = text_at("part", "$.type"), F.coalesce(F.try_variant_get("part", "$.synthetic", "boolean"), F.lit(False))
    none, no_calls = F.lit(None).cast("string"), F.array().cast("array<string>")

    def row(role, content, thinking=none, calls=no_calls, injected=F.lit(False)):
        return F.struct(role.alias("role"), content.alias("content"), thinking.alias("thinking"), calls.alias("tool_calls_summary"), injected.alias("injected"))

    name = F.coalesce(text_at("part", "$.tool"), text_at("part", "$.name"), F.lit("?"))
    args = F.coalesce(F.to_json(F.try_variant_get("part", "$.state.input", "variant")), F.lit("{}"))
    output = F.coalesce(text_at("part", "$.state.output"), F.to_json(F.try_variant_get("part", "$.state.output", "variant")), F.lit(""))
    text = F.coalesce(text_at("part", "$.text"), F.lit(""))
    made = (
        F.when((kind == "text") & ~synthetic, F.array(row(F.col("role"), text)))
        .when((kind == "reasoning") & ~synthetic & (text != ""), F.array(row(F.col("role"), F.lit(""), text)))
        .when(kind == "tool", F.array(row(F.lit("assistant"), F.lit(""), none, F.array(summarize_tool_call(name, args))), row(F.lit("tool"), output)))
        .when(kind == "compaction", F.array(row(F.lit("user"), F.lit(MARKER), injected=F.lit(True))))
    )
    flat = parts.select("session_id", "o1", "o2", "o3", "o4", iso_from_millis("ms").alias("timestamp"), F.posexplode(made).alias("sub", "x")).select("session_id", "o1", "o2", "o3", "o4", "sub", "timestamp", "x.*")
    return ordered(flat, "o1", "o2", "o3", "o4", "sub")


def opencode_messages(spark: SparkSession, path: str) -> DataFrame:
    return messages_of(v2_parts(spark, path) if layout(path) == "v2" else legacy_parts(spark, path))


def _ids(window: DataFrame) -> list[str]:
    """The ids of a window, which has LISTING_ROWS rows at most, for the database to look up."""
    return [r["session_id"] for r in window.select("session_id").collect()]


def opencode_sessions(spark: SparkSession, path: str, cutoff_ms: int = 0, directory: str | None = None) -> DataFrame:
    """The 200 most recent sessions of a window (0: unbounded) with counts, bytes and children.  The window is cut first, and its ids
    go to the database as conditions: no row of a session outside of it is read."""
    v2 = layout(path) == "v2"
    where = ([("time_updated", ">=", cutoff_ms)] if cutoff_ms else []) + ([("directory", "like", f"%{directory}%")] if directory is not None else [])
    s = sqlite_table(spark, path, "session_v2" if v2 else "session", where)
    window, _ = window_sessions(s.withColumn("session_id", F.col("id")), "time_updated")
    among = [("session_id", "in", _ids(window))]
    if v2:
        m = sqlite_table(spark, path, "session_message", among).withColumn("d", F.try_parse_json("data"))
        parts = F.filter(items("d", "$.content"), lambda p: F.coalesce(text_at(p, "$.type") == "tool", F.lit(False)))
        counts = m.groupBy("session_id").agg(F.count_if(F.col("type") == "user").alias("user_count"), F.count_if(F.col("type") == "assistant").alias("assistant_count"), F.sum(F.when(F.col("type") == "assistant", F.size(parts)).otherwise(0)).alias("tool_count"), F.sum(F.when(F.col("type") == "assistant", F.size(items("d", "$.content"))).otherwise(1)).alias("line_count"), F.sum(F.length("data")).alias("file_size"), F.lit(0).alias("compactions"))
    else:
        m = sqlite_table(spark, path, "message", among).withColumn("role", F.get_json_object("data", "$.role"))
        p = sqlite_table(spark, path, "part", among).withColumn("kind", F.get_json_object("data", "$.type"))
        of_m = m.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("user_count"), F.count_if(F.col("role") == "assistant").alias("assistant_count"))
        counts = p.groupBy("session_id").agg(F.count_if(F.col("kind") == "tool").alias("tool_count"), F.count("*").alias("line_count"), F.sum(F.length("data")).alias("file_size"), F.count_if(F.col("kind") == "compaction").alias("compactions")).join(of_m, "session_id", "full")
    kids = children(s, "parent_id", "id", "time_updated").withColumnsRenamed({"parent_id": "session_id", "child_ids": "child_sessions"}).drop("n_children")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("user_count", "assistant_count", "tool_count", "line_count", "file_size")}
    title = F.coalesce("title", "slug", "session_id") if "slug" in s.columns else F.coalesce("title", "session_id")
    out = window.join(counts, "session_id", "left").join(kids, "session_id", "left").withColumns(zero)
    return out.select("session_id", title.alias("title"), iso_from_millis("time_created").alias("start_time"), iso_from_millis("time_updated").alias("end_time"), *zero, (F.coalesce("compactions", F.lit(0)) > 0).alias("has_compaction"), "directory", F.col("parent_id").alias("parent_session_id"), F.coalesce("child_sessions", F.array().cast("array<string>")).alias("child_sessions"), F.lit("database").alias("backend_kind"), F.col("time_updated").alias("updated_ms"))


def todo_flushes(parts: DataFrame) -> DataFrame:
    """Todo snapshots of successful todo calls whose list is readable (input as object or as JSON text)."""
    inp = F.coalesce(F.try_parse_json(text_at("part", "$.state.input")), F.try_variant_get("part", "$.state.input", "variant"))
    todos = F.try_variant_get(inp, "$.todos", "array<struct<content:string,status:string,priority:string>>")
    rows = parts.filter((text_at("part", "$.type") == "tool") & text_at("part", "$.tool").isin("todowrite", "todo")).withColumn("todos", todos).filter("todos is not null")
    from pyspark.sql import Window as W

    return rows.select("session_id", F.row_number().over(W.partitionBy("session_id").orderBy("o1", "o2", "o3", "o4")).alias("flush"), iso_from_millis("ms").alias("timestamp"), "todos")
