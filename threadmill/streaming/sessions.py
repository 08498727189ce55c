"""Structured Streaming forms: growing log folders, todo changes with keyed state, late events.

A file source sees new files, not lines appended to old ones: logs must be rolled or copied in whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadmill.sources.jsonl import text_at
from threadmill.streaming.batches import hourly, sessions


def message_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New JSONL files as parsed records (path, raw, rec); lines that are no JSON have a null rec."""
    raw = spark.readStream.text(folder)
    return raw.filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"), F.try_parse_json("value").alias("rec"))


def role_counts(lines: DataFrame) -> DataFrame:
    return lines.filter("rec is not null").groupBy("path", text_at("rec", "$.role").alias("role")).agg(F.count("*").alias("n"))


def late_hourly(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    return hourly(events.withWatermark("ts", lateness))


def late_sessions(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    return sessions(events.withWatermark("ts", lateness))


TODO_EVENTS = "session_id string, nth long, phase int, pos int, ts string, action string, todo string, status string"
COVERAGE = "session_id string, from_id long, to_id long, accepted boolean, expected_from_id long"
_SLUG = re.compile(r"(item\d+(?:\.\d+)?:)(?=\s)")


def keyed_state(spark: SparkSession) -> None:
    """Keyed state of several variables needs the store that holds it by column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class TodoChanges(StatefulProcessor):
    """The state of a session: the last snapshot's items in order, snapshots that came before their turn by number, how many
    were taken, and the number of the next."""

    def __init__(self, patience_ms: int | None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "key string, content string, status string")
        self.waiting = handle.getMapState("waiting", "flush long", "ts string, contents array<string>, statuses array<string>")
        self.place = handle.getValueState("place", "flush long, nth long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.flush,), (r.timestamp, list(r.contents), list(r.statuses)))
        yield from self._taken(key)
        if self.patience_ms is not None and next(iter(self.waiting.keys()), None) is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A gap that stays open is passed over."""
        yield from self._taken(key, everything=True)

    def _taken(self, key: tuple, everything: bool = False) -> Iterator[Row]:
        flush, nth = self.place.get() if self.place.exists() else (1, 0)
        last = list(self.items.get()) if self.items.exists() else []
        turns = sorted(k[0] for k in self.waiting.keys())
        for turn in turns:
            if turn > flush and not everything:
                break
            ts, contents, statuses = self.waiting.getValue((turn,))
            self.waiting.removeKey((turn,))
            if turn < flush:  # told already
                continue
            flush, nth, now = turn + 1, nth + 1, []
            was: dict[str, tuple[str, str]] = {}
            for k, content, status in last:
                was.setdefault(k, (content, status))
            out = lambda phase, pos, action, todo, status: Row(session_id=key[0], nth=nth, phase=phase, pos=pos, ts=ts or "0", action=action, todo=todo, status=status)  # noqa: B023, E731
            for pos, (content, status) in enumerate(zip(contents, statuses, strict=True)):
                found = _SLUG.match(content)
                k = found[1] if found else content
                now.append((k, content, status))
                if k not in was:
                    yield out(0, pos, "added", content, status)
                elif was[k][1] != status:
                    yield out(0, pos, status, content, status)
                elif was[k][0] != content:
                    yield out(0, pos, "updated", content, status)
            keys = {k for k, _, _ in now}
            for pos, (k, content, _) in enumerate(last):
                if k not in keys:
                    yield out(1, pos, "removed", content, None)
            last = now
        self.place.update((flush, nth))
        if last:
            self.items.put(last)
        else:
            self.items.clear()

    def close(self) -> None:
        pass


def todo_changes(flushes: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """Changes between a session's snapshots (session_id, flush, timestamp, todos), numbered 1, 2, ... by flush, as they come: what
    `todo_events` says of all of them at once, however they are split into batches and in whatever order these come.  A snapshot waits for
    those before it; with `patience_ms` for so long at most, then a gap is passed over.  Repeated snapshots count once."""
    keyed_state(flushes.sparkSession)
    none = F.array().cast("array<string>")
    contents = F.coalesce(F.transform("todos", lambda t: t["content"]), none)
    statuses = F.coalesce(F.transform("todos", lambda t: F.coalesce(t["status"], F.lit(""))), none)
    rows = flushes.select("session_id", F.col("flush").cast("long").alias("flush"), "timestamp", contents.alias("contents"), statuses.alias("statuses"))
    return rows.groupBy("session_id").transformWithState(TodoChanges(patience_ms), TODO_EVENTS, "Append", "None" if patience_ms is None else "ProcessingTime")


class Coverage(StatefulProcessor):
    """The state of a session: the id that its ledger expects next, and blocks that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expected = handle.getValueState("expected", "id long")
        self.waiting = handle.getMapState("waiting", "from_id long", "to_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = self.expected.get()[0] if self.expected.exists() else 1
        told = lambda a, b, ok: Row(session_id=key[0], from_id=a, to_id=b, accepted=ok, expected_from_id=at)
        for r in rows:
            if r.from_id < at or r.to_id < r.from_id or self.waiting.containsKey((r.from_id,)):
                yield told(r.from_id, r.to_id, False)
            else:
                self.waiting.updateValue((r.from_id,), (r.to_id,))
        while self.waiting.containsKey((at,)):
            begin, end = at, self.waiting.getValue((at,))[0]
            self.waiting.removeKey((begin,))
            at = end + 1
            yield told(begin, end, True)
        for begin in sorted(k[0] for k in self.waiting.keys() if k[0] < at):  # overtaken by a longer block
            end = self.waiting.getValue((begin,))[0]
            self.waiting.removeKey((begin,))
            yield told(begin, end, False)
        self.expected.update((at,))

    def close(self) -> None:
        pass


def coverage(blocks: DataFrame) -> DataFrame:
    """Ledger blocks (session_id, from_id, to_id) as they come: (session_id, from_id, to_id, accepted, expected_from_id).  A block is accepted
    when the blocks before it cover all ids up to its own; one that overlaps what is covered, or ends before it begins, is not."""
    keyed_state(blocks.sparkSession)
    return blocks.select("session_id", "from_id", "to_id").groupBy("session_id").transformWithState(Coverage(), COVERAGE, "Append", "None")


def refresh(spark: SparkSession, folder: str, checkpoint: str, recompute) -> None:
    """Call `recompute(paths)` with the paths that have changed since the last call, a DataFrame, and come back."""
    changed = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"))
    changed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: recompute(df)).start().awaitTermination()
