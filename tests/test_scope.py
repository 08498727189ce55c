"""Listings read their window alone; what cannot be read is named or raises."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from threadmill.api import Sessions
from threadmill.operators import slicing
from threadmill.sources import jsonl, opencode
from threadmill.sources.sqlite_source import SqliteReader, sqlite_table
from pyspark.sql.types import StructType

A = "0a0a0a0a-0000-4000-8000-000000000001"


def files_read(df):
    """How many files the scans of a plan have read."""
    df.collect()
    leaves, total = df._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numFiles"):
            total += metrics.apply("numFiles").value()
    return total


def vibe_store(root, old, new):
    for i in range(old + new):
        d = root / f"session_20260101_{i:06d}_a{i}"
        d.mkdir(parents=True)
        (d / "messages.jsonl").write_text(json.dumps({"role": "user", "content": f"alpha {i}"}) + "\n")
        (d / "meta.json").write_text(json.dumps({"title": f"t{i}", "environment": {"working_directory": f"/w/{i % 2}"}}))
        when = 2_000_000_000 if i >= old else 1_000_000_000
        os.utime(d / "messages.jsonl", (when, when))


def test_files_outside_of_the_window_are_not_opened(spark, tmp_path):
    vibe_store(tmp_path / "s", 30, 3)
    s = Sessions(spark, "vibe", str(tmp_path / "s"))
    assert files_read(jsonl.file_stats(spark, str(tmp_path / "s"), "messages.jsonl")) >= 0
    heads = jsonl.whole_files(spark, str(tmp_path / "s"), "messages.jsonl", F.col("_metadata.file_modification_time") >= F.lit("2033-01-01").cast("timestamp"))
    assert files_read(heads) == 3
    cutoff = 1_900_000_000_000
    rows = s.list(cutoff_ms=cutoff).collect()
    assert len(rows) == 3 and {r.title for r in rows} == {"t30", "t31", "t32"} and all(r.user_count == 1 and r.read_error is None for r in rows)
    # what is out of the window may be anything: it is not read
    for i in range(30):
        (tmp_path / "s" / f"session_20260101_{i:06d}_a{i}" / "messages.jsonl").write_text("{broken")
        os.utime(tmp_path / "s" / f"session_20260101_{i:06d}_a{i}" / "messages.jsonl", (1_000_000_000,) * 2)
    again = s.list(cutoff_ms=cutoff)
    assert not [f for f in again.inputFiles() if "messages.jsonl" in f and int(f.split("_a")[-1].split("/")[0]) < 30]
    assert [r.session_id for r in again.collect()] == [r.session_id for r in rows]
    assert [r.title for r in s.list("/w/1", cutoff).collect()] == ["t31"]
    assert s.list("/nowhere", cutoff).count() == 0


def test_damage_is_named_and_sessions_stay_listed(spark, tmp_path):
    vibe_store(tmp_path / "s", 0, 2)
    (tmp_path / "s" / "session_20260101_000000_a0" / "messages.jsonl").write_text("{broken\n\n{again\n")
    s = Sessions(spark, "vibe", str(tmp_path / "s"))
    rows = {r.session_id[-2:]: r for r in s.list().collect()}
    assert "a0/messages.jsonl" in rows["a0"].read_error and (rows["a0"].line_count, rows["a0"].user_count) == (2, 0) and rows["a1"].read_error is None
    assert sorted((r.session_id[-2:], r.line) for r in s.damage().collect()) == [("a0", 1), ("a0", 3)]
    with pytest.raises(ValueError, match="nosuch"):
        Sessions(spark, "vibe", str(tmp_path / "s"), session="nosuch")


def chunk(folder, name, what):
    (folder / "chunks").mkdir(parents=True, exist_ok=True)
    (folder / "chunks" / name).write_text(what if isinstance(what, str) else json.dumps(what))


def said(role, text, at):
    return {"type": "message", "role": role, "source": "turn_start", "id": f"{role}{at}", "createdAt": at, "content": [{"type": "text", "text": text}]}


def test_layouts_of_unified_sessions(spark, tmp_path):
    root = tmp_path / "v"
    ids = [A[:-1] + str(i) for i in range(6)]
    folder = [root / "unified" / i for i in ids]
    chunk(folder[0], "aa.json", [said("user", "hi", 1), said("assistant", "yo", 2)])
    chunk(folder[0], "bb.json", "{not json")
    chunk(folder[0], "cc.json", "12")
    (folder[1]).mkdir()
    (folder[1] / "meta.json").write_text('{"title":"broken"}')
    chunk(folder[2], "aa.json", [{"type": "notice"}, {"type": "checkpoint"}])
    chunk(folder[3], "aa.json", "[]")
    (folder[3] / "journal").mkdir()
    (folder[3] / "journal" / "0001.jsonl").write_text(json.dumps({"type": "core_input", "input": {"parts": [{"type": "text", "text": "from the journal"}]}}) + "\n{bad\n")
    chunk(folder[4], "aa.json", "[]")
    chunk(folder[5], "aa.json", said("user", "alone", 5))
    (root / "session_20260101_000000_zz").mkdir()
    (root / "session_20260101_000000_zz" / "messages.jsonl").write_text(json.dumps({"role": "user", "content": "legacy"}) + "\n")
    s = Sessions(spark, "vibe", str(root))
    got = {}
    for r in s.messages.orderBy("session_id", "seq").collect():
        got.setdefault(r.session_id, []).append(r.content)
    assert got == {ids[0]: ["hi", "yo"], ids[3]: ["from the journal"], ids[5]: ["alone"], "session_20260101_000000_zz": ["legacy"]}
    assert sorted((os.path.basename(r.path), r.session_id, r.line, r.error) for r in s.damage().collect()) == [("0001.jsonl", ids[3], 2, "not valid JSON"), ("bb.json", ids[0], None, "not valid JSON"), ("cc.json", ids[0], None, "neither a record nor an array of records")]
    assert {r.session_id: r.error.split(",")[0] for r in s.errors().collect()} == {ids[1]: "unknown layout (neither chunks nor journal is there)", ids[2]: "2 chunk records"}
    rows = {r.session_id: r for r in s.list().collect()}
    assert rows[ids[0]].line_count == 2 and "bb.json" in rows[ids[0]].read_error and rows[ids[4]].line_count == 0 and ids[1] not in rows
    with pytest.raises(ValueError, match="unknown layout"):
        Sessions(spark, "vibe", str(root), session=ids[1])
    with pytest.raises(ValueError, match="none of them readable"):
        Sessions(spark, "vibe", str(root), session=ids[2])
    assert [r.content for r in Sessions(spark, "vibe", str(root), session=ids[0]).messages.orderBy("seq").collect()] == ["hi", "yo"]
    assert Sessions(spark, "vibe", str(root), session=ids[4]).messages.count() == 0


def database(path, old, new):
    c = sqlite3.connect(path)
    c.executescript("CREATE TABLE session(id TEXT PRIMARY KEY, parent_id TEXT, directory TEXT, title TEXT, time_created INT, time_updated INT); CREATE TABLE message(id TEXT PRIMARY KEY, session_id TEXT, time_created INT, time_updated INT, data TEXT); CREATE TABLE part(id TEXT PRIMARY KEY, message_id TEXT, session_id TEXT, time_created INT, time_updated INT, data TEXT); CREATE INDEX m ON message(session_id, time_created, id); CREATE INDEX p ON part(session_id)")
    c.executemany("INSERT INTO session VALUES (?, NULL, '/w', 'T', 1, ?)", [(f"s{i}", 9000 if i >= old else 10) for i in range(old + new)])
    c.executemany("""INSERT INTO message VALUES (?, ?, 1, 1, '{"role":"user"}')""", [(f"m{i}", f"s{i}") for i in range(old + new)])
    c.executemany("""INSERT INTO part VALUES (?, ?, ?, 1, 1, '{"type":"text","text":"hi"}')""", [(f"p{i}.{k}", f"m{i}", f"s{i}") for i in range(old + new) for k in range(3)])
    c.commit()
    c.close()


def test_rows_outside_of_the_window_are_not_read(spark, tmp_path):
    path = str(tmp_path / "opencode.db")
    database(path, 50, 4)
    among = [("session_id", "in", ["s50", "s51", "s52", "s53"])]
    t = sqlite_table(spark, path, "part", among, 2)
    assert {r.session_id for r in t.select("session_id").collect()} == {"s50", "s51", "s52", "s53"} and t.count() == 12
    reader = SqliteReader(StructType.fromDDL("id string, session_id string, data string"), path, "part", 2, [list(x) for x in among])
    parts = reader.partitions()
    with sqlite3.connect(path) as c:
        plans = [" ".join(r[3] for r in c.execute(f"EXPLAIN QUERY PLAN {reader.statement(p)}", p.values)) for p in parts]
    assert len(parts) == 2 and all("USING INDEX p (session_id=?)" in p for p in plans) and [len(p.values) for p in parts] == [2, 2]
    rows = opencode.opencode_sessions(spark, path, cutoff_ms=5000).collect()
    assert {(r.session_id, r.user_count, r.line_count) for r in rows} == {(f"s{i}", 1, 3) for i in range(50, 54)}
    assert opencode.opencode_sessions(spark, path, cutoff_ms=99_999).count() == 0
    assert sqlite_table(spark, path, "part", [("session_id", "in", [])]).count() == 0
    both = sqlite_table(spark, path, "part", [("session_id", "in", ["s1", "s2"]), ("id", "in", ["p1.0", "p3.0"]), ("time_created", ">", 0)])
    assert [r.id for r in both.collect()] == ["p1.0"]


def test_directories_are_matched_as_a_database_does(spark):
    rows = spark.createDataFrame([(1, "/Work/Été"), (2, "/work/été_x"), (3, None), (4, "C:\\work")], "n int, directory string")
    found = lambda part: [r.n for r in slicing.in_directory(rows, part).orderBy("n").collect()]
    assert found("WORK") == [1, 2, 4] and found("été") == [2] and found("É") == [1] and found("w_rk/%x") == [2] and found("c:\\") == [4]


def put(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def test_each_store_counts_its_lines(spark, tmp_path):
    item = lambda **p: {"type": "response_item", "timestamp": "2026-01-01T00:00:00Z", "payload": p}
    put(tmp_path / "c" / "2026" / "01" / "01" / f"rollout-2026-01-01T00-00-00-{A}.jsonl", {"type": "session_meta", "payload": {"cwd": "/Work"}}, item(type="message", role="user", content=[]), item(type="message", role="developer", content=[]), item(type="function_call", name="x", arguments="{}"), item(type="function_call_output", output="y"), {"type": "compacted", "payload": {}}, "{broken")
    message = lambda role: {"type": "message", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": role, "content": [{"type": "text", "text": "context compaction"}]}}
    put(tmp_path / "p" / "proj" / "2026_p1.jsonl", {"type": "session", "cwd": "/x"}, message("user"), message("assistant"), message("toolResult"), message("system"), "")
    put(tmp_path / "m" / "m1.jsonl", {"role": "user", "content": "context compaction"}, {"role": "tool", "content": "t"}, "{broken")
    told = lambda r: (r.session_id, r.line_count, r.user_count, r.assistant_count, r.tool_count, r.has_compaction, r.read_error is not None)
    codex = Sessions(spark, "codex", str(tmp_path / "c"))
    row = codex.list().first()
    assert told(row) == (A, 7, 1, 1, 1, True, True) and row.directory == "/Work" and row.file_size > 100
    assert codex.list(directory="work").count() == 1 and codex.list(directory="none").count() == 0 and codex.list(cutoff_ms=4_000_000_000_000).count() == 0
    row = Sessions(spark, "pi", str(tmp_path / "p")).list().first()
    assert told(row) == ("p1", 5, 1, 1, 1, False, False) and row.directory == "/x"
    assert told(Sessions(spark, "mock", str(tmp_path / "m")).list().first()) == ("m1", 2, 1, 0, 1, True, True)
    assert Sessions(spark, "codex", str(tmp_path / "c"), session=A[:8]).messages.count() == 4
