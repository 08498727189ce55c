"""The library's front door: stores by name, and one function per report over all their sessions."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill import model
from threadmill.functions.redact import redact_secrets
from threadmill.operators import dedupe, entries, histogram, index, listing, profile, qa, search, slicing, summary, todos
from threadmill.plans import prompts, reports
from threadmill.sources import caches, ledgers, logs, opencode
from threadmill.sources.jsonl import UUID, damage, file_stats, lines, whole_files

HITS = search.HITS
_LEDGER = [f.strip().split(" ")[0] for f in model.LEDGER.split(",")]
META = r"/([^/]+)/meta\.json$"
HARNESS_ALIASES = {"mistral-vibe": "vibe"}


@dataclass(frozen=True)
class Store:
    """How a store is read, what marks a compaction in it, which variable names its root, how ids and folders are matched."""

    name: str
    messages: Callable[[SparkSession, str], DataFrame]
    marker: str
    root_variable: str
    resolve: str
    directory: str
    file_glob: str | None = None
    file_id: str | None = None
    read: Callable[[SparkSession, list[str]], DataFrame] | None = None


def vibe_all(spark: SparkSession, root: str) -> DataFrame:
    """Legacy sessions and unified ones; of a unified session its chunks if they hold a record, else its journal."""
    unified = os.path.join(root, "unified")
    return _vibe(spark, root, None if _missing(spark, unified) else unified)


def _vibe(spark: SparkSession, legacy: str | list[str] | None, unified: str | list[str] | None) -> DataFrame:
    out = logs.vibe_messages(spark, legacy) if legacy else None
    if unified:
        chunks = logs.vibe_chunk_messages(spark, unified)
        journal = logs.vibe_journal_messages(spark, unified)
        layouts = logs.unified_layouts(whole_files(spark, unified)).filter("layout = 'journal'").select("session_id")
        both = chunks.unionByName(journal.join(layouts, "session_id", "left_semi"))
        out = both if out is None else out.unionByName(both)
    return out


def vibe_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same of single files."""
    one, many = [p for p in paths if "/unified/" not in p], [p for p in paths if "/unified/" in p]
    return _vibe(spark, one, many)


def _missing(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


STORES = {
    s.name: s
    for s in (
        Store("mock", logs.mock_messages, "contains", "MOCK_ROLLOUT", "contains", "folded", "*.jsonl", r"([^/]+)\.jsonl$", logs.mock_messages),
        Store("vibe", vibe_all, "contains", "VIBE_SESSIONS_DIR", "shortest", "folded", "*.json*", r"(?:/|^)(session_[^/]+)(?=/messages\.jsonl$)|/unified/([^/]+)(?=/(?:chunks|journal)/)", vibe_files),
        Store("codex", logs.codex_messages, "injected", "CODEX_SESSIONS_DIR", "prefix", "folded", "rollout-*.jsonl", rf"-({UUID}(?:_{UUID})?)\.jsonl$", logs.codex_messages),
        Store("pi", logs.pi_messages, "contains", "PI_SESSIONS_DIR", "prefix", "folded", "*.jsonl", r"_([^_/]+)\.jsonl$", logs.pi_messages),
        Store("opencode", opencode.opencode_messages, "equals", "OPENCODE_DB", "contains", "like"),
    )
}


def store(name: str) -> Store:
    key = HARNESS_ALIASES.get(name, name)
    if key not in STORES:
        raise ValueError(f"unknown store {name!r}; known: {', '.join(sorted(STORES))}")
    return STORES[key]


def resolve_root(name: str, root: str | None = None) -> str:
    """An explicit root, else the store's variable; an empty one counts as unset, and no home folder is ever guessed."""
    found = root or os.environ.get(store(name).root_variable)
    if not found:
        raise ValueError(f"no root for {name}: pass one or set {store(name).root_variable}")
    return found


def check_window(hours_back: int | None, everything: bool, default: int) -> int:
    """Hours of a window: `everything` means 0 (unbounded) and contradicts a number; 0 or nothing means the default."""
    if everything and hours_back:
        raise ValueError("`all` and `hours_back` contradict each other")
    if hours_back is not None and hours_back < 0:
        raise ValueError("hours_back must not be negative")
    return 0 if everything else hours_back or default


class Sessions:
    """All sessions of one store, or one of them.  Reports come as DataFrames; nothing is collected."""

    def __init__(self, spark: SparkSession, harness: str, root: str | None = None, session: str | None = None):
        self.spark, self.store, self.root = spark, store(harness), resolve_root(harness, root)
        self.messages = self.store.messages(spark, self.root)
        if session is not None:
            self.messages = self.one(session)

    @property
    def marker(self) -> Column:
        return slicing.is_marker(self.store.marker)

    def list(self, directory: str | None = None, cutoff_ms: int = 0) -> DataFrame:
        """Listing rows, most recent first, 200 at most.  The window is cut by what the file system says of the files; those of
        other sessions are not opened."""
        if self.store.name == "opencode":
            return opencode.opencode_sessions(self.spark, self.root, cutoff_ms, directory).orderBy(F.desc("updated_ms"), "session_id")
        found = self.window(directory, cutoff_ms)
        rows = found.orderBy(F.desc_nulls_last("mtime"), "session_id").limit(listing.LISTING_ROWS).collect()
        if not rows:
            return self.spark.createDataFrame([], model.SESSIONS)
        paths = [p for r in rows for p in r["paths"]]
        window = self.spark.createDataFrame(rows, found.schema).drop("paths", "head")
        messages = self.store.read(self.spark, paths)
        stamps = profile.first_last(messages).withColumnsRenamed({"first_ts": "start_time", "last_ts": "end_time"})
        own, unified = [p for p in paths if "/unified/" not in p or self.store.name != "vibe"], [p for p in paths if "/unified/" in p and self.store.name == "vibe"]
        counts = logs.line_counts(lines(self.spark, own, self.store.file_glob if self.store.name != "vibe" else "messages.jsonl"), self.store.name, self._id("path")) if own else None
        if unified:  # records of several files make these sessions, so their messages are counted
            more = listing.message_counts(messages.filter(~F.col("session_id").startswith("session_")), self.marker & (F.col("role") == "user")).drop("file_size")
            counts = more if counts is None else counts.unionByName(more)
        bad = self._damage([p for p in paths if "/chunks/" not in p], [p for p in paths if "/chunks/" in p])
        bad = bad.groupBy("session_id").agg(F.array_join(F.sort_array(F.collect_set("path")), ", ").alias("read_error"))
        out = window.join(counts, "session_id", "left").join(stamps, "session_id", "left").join(bad, "session_id", "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts.columns if c.endswith("_count")} | {"has_compaction": F.coalesce("has_compaction", F.lit(False))})
        heads = [r["head"] for r in rows if r["head"]]
        if "directory" not in out.columns and self.store.name != "mock" and heads:
            out = out.join(self._heads(heads), "session_id", "left")
        shape = {"title", "parent_session_id", "directory"} if self.store.name == "vibe" else {"directory"} if self.store.name != "mock" else set()
        out = out.withColumns({c: F.lit(None).cast("string") for c in sorted(shape - set(out.columns))})
        return out.orderBy(F.desc_nulls_last("mtime"), "session_id")

    def window(self, directory: str | None = None, cutoff_ms: int = 0) -> DataFrame:
        """(session_id, mtime, file_size, paths, head) of the sessions in files that changed since, from file names and times; with a
        directory, the heads of these files are read too.  `head` is the file that tells a session's directory, if there is one."""
        named = F.regexp_extract("path", META, 1)
        meta = (named != "") if self.store.name == "vibe" else F.lit(False)
        files = file_stats(self.spark, self.root, self.store.file_glob).withColumns({"meta": meta, "session_id": F.when(meta, named).otherwise(self._id("path"))}).filter("session_id <> ''")
        own = lambda c: F.when(~F.col("meta"), F.col(c))
        head = F.max(F.when(F.col("meta"), F.col("path"))) if self.store.name == "vibe" else F.min("path")
        seen = files.groupBy("session_id").agg(F.max(own("mtime")).alias("mtime"), F.sum(own("size")).alias("file_size"), F.sort_array(F.collect_list(own("path"))).alias("paths"), head.alias("head"))
        seen = seen.filter(F.unix_millis("mtime") >= cutoff_ms)
        if directory is None or self.store.name == "mock":
            return seen
        since = F.col("_metadata.file_modification_time") >= F.timestamp_millis(F.lit(cutoff_ms))
        heads = self._heads(self.root, since if self.store.name != "vibe" else None)  # heads in files of their own have times of their own
        return slicing.in_directory(seen.join(heads, "session_id", "left"), directory, self.store.directory)

    def _id(self, path: str) -> Column:
        """The session that a path belongs to; empty if to none."""
        one = F.regexp_extract(path, self.store.file_id, 1)
        return F.when(one != "", one).otherwise(F.regexp_extract(path, self.store.file_id, 2)) if self.store.name == "vibe" else one

    def _heads(self, paths: str | list[str], only: Column | None = None) -> DataFrame:
        """What the heads of sessions say: directory, and in one store title and parent; only: a condition on the files' metadata."""
        if self.store.name == "vibe":
            return logs.vibe_meta(self.spark, paths, only).select("session_id", "title", "parent_session_id", "directory")
        return logs.first_line_directory(self.spark, paths, self.store.file_glob, self.store.file_id, only)

    def _damage(self, plain: str | list[str], chunks: str | list[str]) -> DataFrame:
        """(session_id, path, line, error) of what cannot be read of lines and of chunk files."""
        bad = damage(lines(self.spark, plain, "*.jsonl")) if plain else self.spark.createDataFrame([], model.DAMAGE)
        if chunks:
            bad = bad.unionByName(logs.chunk_damage(whole_files(self.spark, chunks, "*.json")))
        return bad.withColumn("session_id", self._id("path")).select("session_id", "path", "line", "error")

    def damage(self) -> DataFrame:
        """(session_id, path, line, error) of the lines and files of the store that cannot be read."""
        if not self.store.file_glob:
            raise ValueError("a database names no damaged files")
        return self._damage(self.root, self._unified() or [])

    def _unified(self) -> str | None:
        folder = os.path.join(self.root, "unified")
        return folder if self.store.name == "vibe" and not _missing(self.spark, folder) else None

    def errors(self) -> DataFrame:
        """(session_id, error) of sessions that cannot be read at all: unified ones of an unknown layout or without a readable record."""
        if not (folder := self._unified()):
            return self.spark.createDataFrame([], "session_id string, error string")
        return logs.unified_errors(logs.unified_layouts(whole_files(self.spark, folder)), logs.vibe_chunk_messages(self.spark, folder))

    def one(self, session: str) -> DataFrame:
        """The messages of one session, by its id or a part of it; an unknown id and a session that cannot be read raise."""
        if not self.store.file_glob:
            row = slicing.resolve_session(self.list(), session, self.store.resolve, "end_time").first()
            if row is None:
                raise ValueError(f"no session {session!r} in {self.root}")
            return self.messages.filter(F.col("session_id") == row["session_id"])
        bad = self.errors()
        every = self.window().select("session_id", "mtime", "paths").join(bad, "session_id", "full")
        row = slicing.resolve_session(every, session, self.store.resolve).first()
        if row is None:
            raise ValueError(f"no session {session!r} in {self.root}")
        if row["error"]:
            raise ValueError(f"session {row['session_id']} in {self.root}: {row['error']}")
        return self.store.read(self.spark, row["paths"])

    def profile(self) -> tuple[DataFrame, DataFrame]:
        return reports.profile_session(self.messages, self.store.name)

    def extract(self, full: bool = False, limit: int = 0, offset: int | None = None, max_record_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
        return reports.extract_messages(self.messages, self.marker, full, limit, offset, max_record_bytes)

    def user_messages(self, limit: int = 0, offset: int | None = None) -> tuple[DataFrame, DataFrame]:
        return reports.extract_messages(self.messages, self.marker, True, limit, offset, users_only=True)

    def respond(self, tool: str, max_bytes: int = 0, folder: str | None = None, **options) -> DataFrame:
        """A report as one bounded response per session: `extract_messages`, `extract_user_messages`, `extract_by_type` (kinds), `profile`,
        `said_did` or `prior_period_summary`, with the options of their functions.  0 bytes means the ceiling; streams that do not fit go to `folder` whole."""
        _, most = reports.limits(0, max_bytes)
        if tool == "extract_messages":
            meta, rows = self.extract(**options)
        elif tool == "extract_user_messages":
            meta, rows = self.user_messages(**options)
        elif tool == "extract_by_type":
            counts, rows = self.entries(**options)
            kinds = F.map_from_entries(F.array_sort(F.collect_list(F.struct("entry_type", "n"))))
            meta = self.messages.select("session_id").distinct().join(counts.groupBy("session_id").agg(kinds.alias("counts")), "session_id", "left")
            return reports.respond(tool, meta, rows, most, folder, "idx")
        elif tool == "profile":
            meta, events = self.profile()
            rows = events.withColumns({"at": F.row_number().over(_by("line_number", "event_type")), "json": reports.record("event", *[c for c in events.columns if c != "session_id"])})
            return reports.respond(tool, meta, rows, most, folder, "at")
        elif tool == "said_did":
            said = self.said_did()
            meta = said.groupBy("session_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("he_said", "she_said", "they_did", "compaction_boundary")))
            rows = said.withColumns({"at": F.row_number().over(_by("section", "seq", "pos")), "json": F.to_json(F.struct(F.col("kind").alias("type"), "seq", "body"))})
            return reports.respond(tool, meta, rows, most, folder, "at")
        elif tool == "prior_period_summary":
            meta, rows = self.period(**options)
        else:
            raise ValueError(f"unknown report {tool!r}")
        return reports.respond(tool, meta, rows, most, folder)

    def period(self, plans: str | None = None, cutoff_ms: int = 0) -> tuple[DataFrame, DataFrame]:
        """(meta, sections) of each session's period since its last marker; plans: a folder of markdown plans, cutoff_ms: the window of the table
        of recent sessions.  Stores without todo lists have none."""
        flushes = self.todo_flushes() if self.store.name == "opencode" else self.spark.createDataFrame([], model.TODOS)
        files = logs.plan_files(self.spark, plans) if plans else None
        rows = self.list(cutoff_ms=cutoff_ms)
        stamp = F.col("end_time") if "end_time" in rows.columns else F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        recent = self.window(cutoff_ms=cutoff_ms).count() if self.store.file_glob else None
        return reports.period_report(self.messages, flushes, rows.withColumn("end_time", stamp), self.marker, files, recent)

    def derived(self, full: bool = False) -> dict[str, DataFrame]:
        rows = self.messages if full else slicing.since_last_marker(self.messages, self.marker)
        out = {"compaction": rows.filter(self.marker).select("session_id", F.col("seq").alias("n"), "timestamp", F.to_json(F.struct("content")).alias("record"))}
        pairs = logs.vibe_question_pairs(lines(self.spark, self.root, "messages.jsonl")) if self.store.name == "vibe" else qa.pairs_of_messages(self.messages)
        pairs = pairs.join(self.messages.select("session_id").distinct(), "session_id", "left_semi")
        if not full:  # what the slice asks
            first = rows.groupBy("session_id").agg(F.min(F.coalesce("line", "seq") if self.store.name == "vibe" else F.col("seq")).alias("least"))
            pairs = pairs.join(first, "session_id").filter("seq >= least").drop("least")
        out["questions"] = qa.as_entries(pairs)
        if self.store.name == "opencode":
            e = todos.todo_events(self.todo_flushes())
            out["todo"] = e.select("session_id", F.row_number().over(_by("nth", "phase", "pos")).alias("n"), F.col("ts").alias("timestamp"), F.to_json(F.struct("action", "todo", "status")).alias("record"))
        return out

    def todo_flushes(self) -> DataFrame:
        if self.store.name != "opencode":
            raise ValueError(f"todo history is not kept by {self.store.name}")
        parts = opencode.v2_parts if opencode.layout(self.root) == "v2" else opencode.legacy_parts
        return opencode.todo_flushes(parts(self.spark, self.root))

    def entries(self, kinds: list[str], full: bool = False, include_injected: bool = False, limit: int = 0, offset: int | None = None) -> tuple[DataFrame, DataFrame]:
        return reports.extract_by_type(self.messages, self.derived(full), entries.check_kinds(kinds), self.marker, full, include_injected, limit, offset, self.native_entries(full, include_injected))

    def native_entries(self, full: bool = False, include_injected: bool = False) -> DataFrame | None:
        """Entries whose records are the log's own lines, for the store that has them; its unified sessions make theirs of messages."""
        if self.store.name != "vibe":
            return None
        own = logs.native_entries(lines(self.spark, self.root, "messages.jsonl"), full, include_injected).drop("line")
        own = own.join(self.messages.select("session_id").distinct(), "session_id", "left_semi")
        other = self.messages.filter(~F.col("session_id").startswith("session_"))
        return own.unionByName(entries.typed_entries(other if full else slicing.since_last_marker(other, self.marker), include_injected))

    def said_did(self) -> DataFrame:
        return reports.said_did(self.messages, self.marker)

    def search(self, query: str, hits: int = HITS) -> DataFrame:
        """Hits over the messages themselves, without an index."""
        return search.search(self.messages, query, hits)

    def index(self, folder: str, only: DataFrame | None = None) -> DataFrame:
        """Index all sessions, or those of `only` (session_id), into a folder: (session_id, doc_count)."""
        rows = self.messages if only is None else self.messages.join(only.select("session_id").distinct(), "session_id", "left_semi")
        return index.index_messages(rows, folder, self.window().select("session_id", "mtime") if self.store.file_glob else None)

    def search_index(self, folder: str, query: str, ids: list[str] | None = None, directory: str | None = None, cutoff_ms: int = 0, hits: int = HITS) -> tuple[DataFrame, DataFrame]:
        """(meta, hits) from an index.  `ids` are parts of session ids, each meaning the most recent session that holds it; without them the
        window and directory decide.  Stale sessions in files are indexed first; a database cannot tell, so what it lacks is only named."""
        listed = self.window if self.store.file_glob else self.list
        rows = listed(directory if not ids else None, cutoff_ms if not ids else 0)
        kind = F.lit("file" if self.store.file_glob else "database")
        mtime = F.col("mtime") if self.store.file_glob else F.lit(None).cast("timestamp").alias("mtime")
        every = rows.select("session_id", mtime, kind.alias("backend_kind"))
        none = self.spark.createDataFrame([], "pos long, id string")
        selected, unmatched = every, none
        if ids:
            wanted = self.spark.createDataFrame(list(enumerate(ids)), "pos long, id string")
            recent = rows.select("session_id", F.row_number().over(W.orderBy(F.desc_nulls_last("mtime" if self.store.file_glob else "updated_ms"), "session_id")).alias("ord"))
            chosen, unmatched = slicing.select_sessions(recent, wanted)
            selected = every.join(chosen, "session_id", "left_semi")
        behind = index.stale(self.spark, folder, selected).filter("backend_kind = 'file'")
        if not behind.isEmpty():
            self.index(folder, behind)
        return index.search_report(self.spark, folder, query, selected.select("session_id"), unmatched, hits)

    def summary_status(self, folder: str) -> DataFrame:
        """Blocks, coverage and the counts of what is not summarised yet, per session, from a folder of ledgers."""
        return summary.status(ledgers.ledger(self.spark, folder).select(*_LEDGER), self.messages)

    def summarise_from(self, folder: str, session: str, from_id: int, summarizer: Callable[[str, str], str]) -> DataFrame:
        """Summarise one session from the id that its ledger expects, another raises; the block is appended to the folder."""
        mine = self.one(session)
        block = summary.summarise(mine, ledgers.ledger(self.spark, folder).select(*_LEDGER), from_id, summarizer)
        ids = mine.withColumn("id", F.row_number().over(_by("seq"))).filter(F.col("id") >= from_id)
        made = self.spark.createDataFrame([block], "session_id string, from_id long, to_id long, from_ts string, to_ts string, text string")
        ledgers.append(made.join(summary.slice_counts(ids), "session_id"), folder)
        return ledgers.compose(self.spark, folder).filter(F.col("session_id") == block["session_id"])

    def cached_profiles(self, folder: str) -> DataFrame:
        """Counts of all sessions: those that are kept and still true, and the others counted anew and kept.  Stores without times of their
        own count anew."""
        if not self.store.file_glob:
            return listing.message_counts(self.messages, self.marker)
        seen = self.window().select("session_id", "mtime")
        kept = caches.fresh(caches.profiles(self.spark, folder), seen)
        late = seen.join(kept, "session_id", "left_anti")
        made = listing.message_counts(self.messages.join(late, "session_id", "left_semi"), self.marker)
        caches.write_profiles(made, folder)
        return caches.profiles(self.spark, folder).join(seen, "session_id", "left_semi").drop("written_at")

    def prompt(self, budget: int = prompts.BUDGET) -> DataFrame:
        return prompts.bounded_prompt(slicing.since_last_marker(self.messages, self.marker), budget)

    def copies(self) -> DataFrame:
        """Sessions with equal content: the first by id and its aliases."""
        body = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "role", "content")))), 256)
        return dedupe.aliases(self.messages.groupBy("session_id").agg(F.count("*").alias("line_count"), body.alias("hash")).withColumn("d", F.lit(0)), ["line_count", "hash"], "d")


def _by(*order: str):
    from pyspark.sql import Window as W

    return W.partitionBy("session_id").orderBy(*order)


__all__ = ["HARNESS_ALIASES", "STORES", "Sessions", "Store", "check_window", "histogram", "qa", "redact_secrets", "resolve_root", "store"]
