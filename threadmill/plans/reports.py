"""The reports: each composes operators and gives its meta record and its records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.functions.text import clamp, plural
from threadmill.operators import budget, entries, listing, profile, slicing, summary, todos
from threadmill.plans.prompts import bounded_prompt

MAX_BYTES, PAGE, PAGE_MAX, CEILING, SINK = 16_384, 100, 1000, 8 << 20, 16_384


def limits(limit: int = 0, max_bytes: int = 0) -> tuple[int, int]:
    """0 means the default; a page above its maximum raises."""
    if not 0 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be 0..{PAGE_MAX}")
    if not 0 <= max_bytes <= CEILING:
        raise ValueError(f"max_bytes must be 0..{CEILING}")
    return limit or PAGE, max_bytes or CEILING


def record(kind: str, *columns: Column | str) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), *columns))


def sink(records: DataFrame, max_bytes: int = SINK) -> tuple[DataFrame, DataFrame]:
    """records (session_id, seq, json): those that the response admits, greedily, and a row per session with returned and
    total bytes and records."""
    sized = records.withColumn("len", F.octet_length("json"))
    admitted = records.join(budget.greedy_admission(sized, max_bytes, "len"), ["session_id", "seq"]).filter("admitted").drop("admitted")
    total = sized.groupBy("session_id").agg(F.count("*").alias("records"), F.sum("len").alias("bytes"))
    got = admitted.groupBy("session_id").agg(F.count("*").alias("returned_records"), F.sum(F.octet_length("json")).alias("returned_bytes"))
    return admitted, total.join(got, "session_id", "left").fillna(0)


def respond(tool: str, meta: DataFrame, records: DataFrame, max_bytes: int = SINK, folder: str | None = None, order: str = "seq") -> DataFrame:
    """What a report answers, per session of `meta`: (session_id, response, returned_bytes, total_bytes, total_lines, records_returned,
    records_total, overflow, full_report).

    The stream is the meta record (type, tool and the columns of `meta`), then `records` (session_id, json) in their order.  The response is a
    JSON array of what fits `max_bytes`, admitted greedily in that order and never torn.  Of sessions whose response lacks a record the whole
    stream goes to `folder`, a JSON line each, and full_report names its files; the others leave none."""
    first = meta.select("session_id", F.lit(-1).cast("long").alias("at"), F.to_json(F.struct(F.lit("meta").alias("type"), F.lit(tool).alias("tool"), *meta.columns)).alias("json"))
    rest = records.join(meta.select("session_id"), "session_id", "left_semi").select("session_id", F.col(order).cast("long").alias("at"), "json")
    stream = first.unionByName(rest).withColumn("len", F.octet_length("json"))
    told = stream.join(budget.greedy_admission(stream, max_bytes, "len", seq="at"), ["session_id", "at"])
    # only what is admitted is collected, and that has max_bytes at most
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("admitted"), F.struct("at", "json")))), lambda x: x["json"])
    out = told.groupBy("session_id").agg(kept.alias("kept"), F.count("*").alias("total_lines"), (F.sum("len") + F.count("*") + 1).alias("total_bytes"), F.count_if(F.col("admitted") & (F.col("at") >= 0)).alias("records_returned"), F.count_if(F.col("at") >= 0).alias("records_total"), F.bool_or(~F.col("admitted")).alias("overflow"))
    body = F.concat(F.lit("["), F.array_join("kept", ","), F.lit("]"))
    out = out.select("session_id", body.alias("response"), F.octet_length(body).alias("returned_bytes"), "total_bytes", "total_lines", "records_returned", "records_total", "overflow")
    if folder is None:
        return out.withColumn("full_report", F.lit(None).cast("string"))
    over = out.filter("overflow").select("session_id")
    write_stream(stream.join(over, "session_id", "left_semi"), folder)
    return out.withColumn("full_report", F.when(F.col("overflow"), F.concat(F.lit(f"{folder}/session="), F.hex(F.encode("session_id", "utf-8")))))


def write_stream(stream: DataFrame, folder: str) -> None:
    """Streams (session_id, at, json) as JSON lines in order, in a folder per session that is named by the hex digits of its id; a session's
    earlier stream is replaced."""
    lines = stream.select(F.hex(F.encode("session_id", "utf-8")).alias("session"), "at", "json").repartition("session").sortWithinPartitions("session", "at")
    lines.select("session", "json").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").text(folder)


def stream_lines(records: DataFrame) -> DataFrame:
    """`type,timestamp,json` lines."""
    return records.select(F.concat_ws(",", "type", F.coalesce("timestamp", F.lit("0")), "json").alias("value"))


def list_sessions(sessions: DataFrame, indexed: DataFrame, ledger: DataFrame, now: Column, hours: int = 240) -> tuple[DataFrame, DataFrame]:
    seen = slicing.within_hours(sessions, now, hours)
    window, total = listing.window_sessions(seen, "end_time")
    rows = listing.annotate(listing.listing_row(window), indexed, ledger)
    return total, rows.withColumn("json", record("row", *rows.columns)).select("session_id", "json")


def profile_session(messages: DataFrame, harness: str) -> tuple[DataFrame, DataFrame]:
    counts = profile.role_map(profile.role_counts(messages))
    return counts.join(profile.first_last(messages), "session_id", "left"), profile.interesting_events(messages, harness)


def extract_messages(messages: DataFrame, marker: Column, full: bool = False, limit: int = 0, offset: int | None = None, max_record_bytes: int = 0, users_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bounds per session, and the page's messages, cut to size."""
    rows = slicing.user_messages(messages) if users_only else messages if full else slicing.since_last_marker(messages, marker)
    n, _ = limits(limit)
    total = rows.groupBy("session_id").agg(F.count("*").alias("total"))
    body, cut = clamp("content", max_record_bytes)
    page = slicing.page(rows, n, offset).withColumns({"truncated": cut, "content": body})
    got = page.groupBy("session_id").agg(F.count("*").alias("returned"), F.count_if("truncated").alias("truncated"))
    return total.join(got, "session_id", "left").fillna(0), page.withColumn("json", record("message", "role", "content", "thinking", "tool_calls_summary", "timestamp", "injected", "truncated"))


def extract_by_type(messages: DataFrame, derived: dict[str, DataFrame], kinds: list[str], marker: Column, full: bool = False, include_injected: bool = False, limit: int = 0, offset: int | None = None, typed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`typed`: the store's own entries, in place of those that messages make."""
    rows = messages if full else slicing.since_last_marker(messages, marker)
    typed = entries.with_derived(entries.typed_entries(rows, include_injected) if typed is None else typed, derived)
    wanted = entries.of_kinds(typed, kinds)
    meta = wanted.groupBy("session_id", "entry_type").agg(F.count("*").alias("n"))
    return meta, slicing.page(wanted, limits(limit)[0], offset, seq="idx").withColumn("json", record("entry", "entry_type", "timestamp", "record"))


def said_did(messages: DataFrame, marker: Column) -> DataFrame:
    """(session_id, section, seq, kind, pos, body): all that the user said, then all that the assistant said, then its
    calls with the markers before the calls of their message."""
    said = slicing.user_messages(messages).filter("content <> ''").select("session_id", F.lit(0).alias("section"), "seq", F.lit("he_said").alias("kind"), F.lit(0).alias("pos"), F.col("content").alias("body"))
    replied = messages.filter((F.col("role") == "assistant") & (F.trim("content") != "")).select("session_id", F.lit(1).alias("section"), "seq", F.lit("she_said").alias("kind"), F.lit(0).alias("pos"), F.col("content").alias("body"))
    marks = messages.filter(marker).select("session_id", F.lit(2).alias("section"), "seq", F.lit("compaction_boundary").alias("kind"), F.lit(-1).alias("pos"), F.col("content").alias("body"))
    calls = messages.select("session_id", F.lit(2).alias("section"), "seq", F.lit("they_did").alias("kind"), F.posexplode("tool_calls_summary").alias("pos", "body"))
    return said.unionByName(replied).unionByName(marks).unionByName(calls)


def compaction_points(messages: DataFrame, marker: Column) -> DataFrame:
    """1-based places of the markers in each session."""
    ids = messages.withColumn("id", F.row_number().over(W.partitionBy("session_id").orderBy("seq")))
    return ids.filter(marker).groupBy("session_id").agg(F.array_sort(F.collect_list("id")).alias("compaction_points"))


def commits(messages: DataFrame) -> DataFrame:
    flat = messages.select("session_id", "seq", F.posexplode("tool_calls_summary").alias("pos", "summary"))
    return flat.filter(F.contains("summary", F.lit("git commit")))


SECTIONS = ("state", "goals", "todo_log", "steers", "rollouts", "plans", "commits", "compactions", "churn")


def prior_period(messages: DataFrame, flushes: DataFrame, sessions: DataFrame, marker: Column, summarizer: Callable[[str, str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(meta, sections) of every session's period since its last marker.  sections: session_id, ord, section, line.  Prompts
    of state and goals are sections as they are; a summarizer, if given, turns one session's prompts into text on the driver."""
    rows = slicing.since_last_marker(messages, marker)
    users = slicing.user_messages(rows)
    events = todos.todo_events(flushes)
    first = flushes.groupBy("session_id").agg(F.min_by(F.size("todos"), "flush").alias("baseline"))
    churned = todos.churn(events, first)
    prompt = {"state": bounded_prompt(rows), "goals": bounded_prompt(users)}
    if summarizer:
        one = messages.select("session_id").distinct().limit(2).count()
        if one > 1:
            raise ValueError("a summarizer takes one session")
        spark = messages.sparkSession
        prompt = {k: spark.createDataFrame([(r["session_id"], summarizer(k, r["text"])) for r in p.limit(1).collect()], "session_id string, text string") for k, p in prompt.items()}

    def part(name: str, df: DataFrame, line: Column, order: str | Column = "session_id") -> DataFrame:
        nth = F.row_number().over(W.partitionBy("session_id").orderBy(order))
        return df.select("session_id", F.lit(SECTIONS.index(name)).alias("ord"), F.lit(name).alias("section"), nth.alias("nth"), line.alias("line"))

    log = todos.latest(events.withColumn("at", F.struct("nth", "phase", "pos")), 200, order="at")
    steer = todos.latest(users, 3)
    footer = summary.compaction_footer(messages, marker)
    out = [
        *(part(k, p, F.col("text")) for k, p in prompt.items()),
        part("todo_log", log, F.concat_ws(" ", "ts", "action", "todo"), "at"), part("steers", steer, F.col("content"), "seq"),
        part("rollouts", sessions, F.concat_ws(" | ", "session_id", "end_time"), F.desc("end_time")), part("commits", commits(rows).withColumn("at", F.struct("seq", "pos")), F.col("summary"), "at"),
        part("compactions", footer, F.concat(plural("messages_since", "message"), F.lit(", "), plural("lines_since", "line"), F.lit(" since")), "seq"),
        part("churn", churned.filter("churning"), F.concat(F.col("opened").cast("string"), F.lit(" opened, "), F.col("closed").cast("string"), F.lit(" closed"))),
    ]
    sections = out[0]
    for p in out[1:]:
        sections = sections.unionByName(p)
    meta = rows.groupBy("session_id").agg(F.count("*").alias("messages"), F.count_if((F.col("role") == "user") & ~F.col("injected")).alias("user_messages")).join(churned, "session_id", "left").join(commits(rows).groupBy("session_id").agg(F.count("*").alias("commits")), "session_id", "left").fillna(0)
    return meta, sections


#: Sections of a period's report in their order, and what stands where a session has nothing to say.
PERIOD = {
    "recent_rollouts": "No recent sessions.", "plan_files": "No plan or todo files found.", "todo_log": "No changes of the todo list.", "commits": "No commits in this period.",
    "state_summary": "", "goals_summary": "", "compaction_footer": "No compaction yet.",
    "instructions": "Read the sections in their order; the logs are complete, the summaries are not.",
    "orientation_warning": "This report does not say what was under way or comes next: look at the work itself before going on.",
}


def period_report(messages: DataFrame, flushes: DataFrame, sessions: DataFrame, marker: Column, plans: DataFrame | None = None, recent: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(meta, records) of every session's period since its last marker: records (session_id, seq, name, text, json) are the nine sections
    of `PERIOD`, meta the counters behind them.  sessions: listing rows; plans: (path, mtime, size) of plan files; recent: sessions in the window,
    if the listing has fewer."""
    counted, lines = prior_period(messages, flushes, sessions, marker)
    rows = slicing.since_last_marker(messages, marker)
    name = F.create_map(*(F.lit(x) for pair in (("state", "state_summary"), ("goals", "goals_summary"), ("todo_log", "todo_log"), ("churn", "todo_log"), ("steers", "todo_log"), ("commits", "commits"), ("compactions", "compaction_footer")) for x in pair))
    place = F.when(F.col("section") == "churn", 1).when(F.col("section") == "steers", 2).otherwise(0)
    churning = lines.filter("section = 'churn'").select("session_id", F.lit(True).alias("churning")).distinct()
    own = lines.filter("section not in ('rollouts', 'plans')").join(churning, "session_id", "left").filter("section <> 'steers' or churning")  # steers explain churn
    own = own.withColumns({"name": name[F.col("section")], "at": F.struct(place.alias("place"), "nth")}).groupBy("session_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("own"))
    table = listing.rollouts_table(sessions).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("table"), F.count("*").alias("rollout_table_rows"))
    stamp = F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    files = F.lit("").alias("files")
    shared = table.withColumn("files", files) if plans is None else table.join(plans.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("- %s (%d bytes, mtime: %s)", "path", "size", stamp))), "\n").alias("files")))
    names = F.array(*(F.struct(F.lit(i).cast("long").alias("seq"), F.lit(n).alias("name"), F.lit(t).alias("none")) for i, (n, t) in enumerate(PERIOD.items())))
    every = messages.select("session_id").distinct().select("session_id", F.inline(names)).join(own, ["session_id", "name"], "left").join(F.broadcast(shared))
    text = F.when(F.col("name") == "recent_rollouts", F.col("table")).when(F.col("name") == "plan_files", F.col("files")).otherwise(F.col("own"))
    told = every.withColumn("text", F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.col("none")))
    records = told.select("session_id", "seq", "name", "text", F.to_json(F.struct(F.lit("section").alias("type"), "name", "text")).alias("json"))
    events = todos.todo_events(flushes).groupBy("session_id").agg(F.count("*").alias("todo_events"))
    writes = flushes.groupBy("session_id").agg(F.count("*").alias("todo_writes"), F.min_by(F.size("todos"), "flush").cast("long").alias("todo_baseline"))
    whole = messages.groupBy("session_id").agg(F.count("*").alias("full_session_messages_count"))
    counters = counted.select("session_id", F.col("messages").alias("session_messages_count"), F.col("user_messages").alias("user_messages_count"), F.col("opened").alias("todo_opens"), F.col("closed").alias("todo_closes"), F.col("commits").alias("commits_in_period"))
    meta = counters.join(whole, "session_id", "left").join(events, "session_id", "left").join(writes, "session_id", "left")
    for kind, prompt in (("state", bounded_prompt(rows)), ("goals", bounded_prompt(slicing.user_messages(rows)))):
        sizes = {"bytes": "prompt_bytes", "dropped_bytes": "prompt_dropped_bytes", "dropped_items": "prompt_dropped_messages"}
        meta = meta.join(prompt.select("session_id", *(F.col(c).cast("long").alias(f"{kind}_{n}") for c, n in sizes.items())), "session_id", "left")
    meta = meta.join(F.broadcast(table.select("rollout_table_rows"))).fillna(0)
    return meta.withColumn("recent_sessions_count", F.lit(recent) if recent is not None else F.col("rollout_table_rows")), records
