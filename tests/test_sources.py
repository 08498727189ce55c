import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from threadmill.sources import jsonl, logs, opencode
from threadmill.sources.sqlite_source import layout, sqlite_table

A, B = "0a0a0a0a-0000-4000-8000-000000000001", "0b0b0b0b-0000-4000-8000-000000000002"


def put(path, *records, raw=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def rows(df):
    return [(r.role, r.content, r.thinking, list(r.tool_calls_summary), r.injected) for r in df.orderBy("session_id", "seq").collect()]


def test_damage_keeps_physical_lines(spark, tmp_path):
    put(tmp_path / "m.jsonl", {"role": "user", "content": "a"}, "", "{broken", {"role": "user", "content": "b"})
    parsed = jsonl.lines(spark, str(tmp_path))
    assert [r.line for r in jsonl.damage(parsed).collect()] == [3] and sorted(r.line for r in parsed.collect()) == [1, 3, 4]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        jsonl.whole_files(spark, str(tmp_path / "none"))


def test_mock(spark, tmp_path):
    put(tmp_path / "s1.jsonl", {"role": "user", "content": "a", "tool_calls_summary": [], "injected": False}, {"role": "assistant", "content": "b", "tool_calls_summary": ["x"], "injected": True})
    assert rows(logs.mock_messages(spark, str(tmp_path))) == [("user", "a", None, [], False), ("assistant", "b", None, ["x"], True)]


def test_vibe(spark, tmp_path):
    folder = tmp_path / "session_20260101_000000_aa"
    put(folder / "messages.jsonl", {"content": "a"}, {"role": "assistant", "content": None, "reasoning_content": "hm", "tool_calls": [{"function": {"name": "bash", "arguments": '{"command":"ls"}'}}, {"name": "z"}]})
    put(folder / "meta.json", {"title": "t", "start_time": "2026-01-01T00:00:00", "environment": {"working_directory": "/w"}})
    assert rows(logs.vibe_messages(spark, str(tmp_path))) == [("unknown", "a", None, [], False), ("assistant", "", None, ["bash: ls", "z()"], False)]
    assert logs.vibe_meta(spark, str(tmp_path)).first().directory == "/w"


def test_vibe_journal(spark, tmp_path):
    put(tmp_path / "unified" / A / "journal" / "0001.jsonl", {"type": "core_input", "input": {"parts": [{"type": "text", "text": "hi"}], "determinism": {"time_unix_ms": 1700000000000}}}, {"type": "receipt_succeeded"}, {"type": "core_input", "input": {"parts": []}})
    put(tmp_path / "unified" / A / "journal" / "0002.jsonl", {"type": "action_result", "parts": [{"type": "reasoning", "text": "hm"}, {"type": "text", "text": "yo"}, {"type": "tool_call", "name": "bash", "arguments": '{"command":"ls"}'}]})
    m = logs.vibe_journal_messages(spark, str(tmp_path))
    assert rows(m) == [("user", "hi", None, [], False), ("assistant", "yo", "hm", ["bash: ls"], False)]
    assert m.orderBy("seq").first().timestamp == "2023-11-14T22:13:20Z"


def test_vibe_chunks(spark, tmp_path):
    part = lambda t: [{"type": "text", "text": t}]
    live = [{"type": "message", "role": "user", "source": "turn_start", "id": "1", "createdAt": 2, "content": part("hi")}, {"type": "reasoning", "id": "2", "createdAt": 3, "text": "hm"}, {"type": "effect", "id": "3", "createdAt": 4, "detail": {"toolName": "bash", "input": {"raw": '{"command":"ls"}'}}, "state": {"output": {"content": part("out")}}}]
    put(tmp_path / "unified" / A / "chunks" / "aa.json", live)
    put(tmp_path / "unified" / A / "chunks" / "bb.json", [*live[:1], {"source": "history", "turn_index": 0, "message": {"role": "user", "content": part("hi ")}}, {"source": "history", "message": {"role": "user", "content": part("older")}}])
    got = rows(logs.vibe_chunk_messages(spark, str(tmp_path)))
    assert got[:3] == [("user", "hi", None, [], False), ("assistant", "", "hm", [], False), ("tool", "out", None, ["bash: ls"], False)] and [g[1] for g in got[3:]] == ["older"]


def test_codex(spark, tmp_path):
    item = lambda **p: {"type": "response_item", "timestamp": "t", "payload": p}
    put(
        tmp_path / "2026" / "11" / "12" / f"rollout-2026-11-12T00-00-00-{A}.jsonl", {"type": "session_meta", "payload": {"cwd": "/w"}}, item(type="message", role="developer", content=[]),
        item(type="message", role="user", content=[{"type": "input_text", "text": "a"}, {"type": "input_text", "text": "b"}]), item(type="function_call", name="bash", arguments='{"command":"ls"}'),
        item(type="custom_tool_call_output", output=[{"text": "x"}, {"text": "y"}]), item(type="function_call_output", output="z"), item(type="reasoning"), {"type": "compacted", "payload": {}},
    )
    assert rows(logs.codex_messages(spark, str(tmp_path))) == [("user", "a\nb", None, [], False), ("assistant", "", None, ["bash: ls"], False), ("tool", "x\ny", None, [], False), ("tool", "z", None, [], False), ("system", "context compaction", None, [], True)]
    d = logs.first_line_directory(spark, str(tmp_path), "rollout-*.jsonl", rf"-({jsonl.UUID})\.jsonl$").first()
    assert (d.session_id, d.directory) == (A, "/w")


def test_pi(spark, tmp_path):
    msg = lambda **m: {"type": "message", "timestamp": "t", "message": m}
    put(tmp_path / "proj" / f"2026_{A}.jsonl", {"type": "session", "cwd": "/w"}, msg(role="system", content=[]), msg(role="user", content=[{"type": "text", "text": "a"}]), msg(role="assistant", content=[{"type": "thinking", "thinking": "hm"}, {"type": "toolCall", "name": "grep", "arguments": {"pattern": "p"}}]), msg(role="toolResult", content=[{"type": "text", "text": "r"}]))
    assert rows(logs.pi_messages(spark, str(tmp_path))) == [("user", "a", None, [], False), ("assistant", "", "hm", ["grep(p, .)"], False), ("tool", "r", None, [], False)]


@pytest.fixture
def legacy(tmp_path):
    path = str(tmp_path / "opencode.db")
    c = sqlite3.connect(path)
    c.executescript("CREATE TABLE session(id TEXT PRIMARY KEY, parent_id TEXT, directory TEXT, title TEXT, time_created INT, time_updated INT); CREATE TABLE message(id TEXT PRIMARY KEY, session_id TEXT, time_created INT, time_updated INT, data TEXT); CREATE TABLE part(id TEXT PRIMARY KEY, message_id TEXT, session_id TEXT, time_created INT, time_updated INT, data TEXT);")
    c.executemany("INSERT INTO session VALUES (?,?,?,?,?,?)", [("s1", None, "/Work", "T", 1000, 9000), ("s2", "s1", "/x", None, 1000, 2000)])
    c.executemany("INSERT INTO message VALUES (?,?,?,?,?,?)".replace(",?)", ")"), [("m1", "s1", 1, 1, '{"role":"user"}'), ("m2", "s1", 2, 2, '{"role":"assistant"}')])
    todo = {"type": "tool", "tool": "todowrite", "state": {"status": "completed", "input": {"todos": [{"content": "a", "status": "pending"}]}, "output": "done"}}
    parts = [{"type": "text", "text": "hi"}, {"type": "text", "text": "no", "synthetic": True}, {"type": "reasoning", "text": "hm"}, todo, {"type": "compaction"}]
    c.executemany("INSERT INTO part VALUES (?,?,?,?,?,?)", [(f"p{i}", "m1" if i < 2 else "m2", "s1", i, i, json.dumps(p)) for i, p in enumerate(parts)] + [("p9", "m2", "s1", 9, 9, "{broken")])
    c.commit()
    c.close()
    return path


def test_sqlite_conditions_reach_the_file(spark, legacy):
    t = sqlite_table(spark, legacy, "session", [("time_updated", ">", 5000)], 2)
    assert [r.id for r in t.collect()] == ["s1"] and t.filter("id = 's2'").count() == 0 and layout(legacy) == "legacy"
    assert sqlite_table(spark, legacy, "session").filter(F.col("time_updated") < 5000).count() == 1
    with pytest.raises(Exception, match="unknown operator"):
        sqlite_table(spark, legacy, "session", [("id", "; drop", 1)]).collect()


def test_opencode_legacy(spark, legacy):
    m = opencode.opencode_messages(spark, legacy)
    assert rows(m) == [("user", "hi", None, [], False), ("assistant", "", "hm", [], False), ("assistant", "", None, ['todowrite({"todos":[{"content":"a","status":"pending"}]})'], False), ("tool", "done", None, [], False), ("user", "context compaction", None, [], True)]
    s = opencode.opencode_sessions(spark, legacy, directory="work").first()
    assert (s.session_id, s.user_count, s.assistant_count, s.tool_count, s.has_compaction, s.title) == ("s1", 1, 1, 1, True, "T")
    assert opencode.opencode_sessions(spark, legacy).orderBy("session_id").first().child_sessions == ["s2"]
    f = opencode.todo_flushes(opencode.legacy_parts(spark, legacy)).collect()
    assert [(x.flush, x.todos[0].content) for x in f] == [(1, "a")]


def test_opencode_v2(spark, tmp_path):
    path = str(tmp_path / "opencode.db")
    c = sqlite3.connect(path)
    c.executescript("CREATE TABLE session_v2(id TEXT PRIMARY KEY, parent_id TEXT, slug TEXT, directory TEXT, title TEXT, time_created INT, time_updated INT); CREATE TABLE session_message(id TEXT PRIMARY KEY, session_id TEXT, type TEXT, seq INT, time_created INT, time_updated INT, data TEXT);")
    c.execute("INSERT INTO session_v2 VALUES ('s', NULL, 'slug', '/w', NULL, 1, 2)")
    data = [("user", {"text": "hi"}), ("assistant", {"content": [{"type": "text", "text": "yo"}, {"type": "tool", "name": "bash", "state": {"input": {"command": "ls"}, "output": "o"}}]}), ("compaction", {"status": "done"}), ("synthetic", {"text": "no"}), ("other", {})]
    c.executemany("INSERT INTO session_message VALUES (?,?,?,?,?,?,?)", [(f"m{i}", "s", t, i, i, i, json.dumps(d)) for i, (t, d) in enumerate(data)])
    c.commit()
    c.close()
    assert rows(opencode.opencode_messages(spark, path)) == [("user", "hi", None, [], False), ("assistant", "yo", None, [], False), ("assistant", "", None, ["bash: ls"], False), ("tool", "o", None, [], False), ("user", "context compaction", None, [], True)]
    s = opencode.opencode_sessions(spark, path).first()
    assert (s.title, s.tool_count, s.line_count, s.has_compaction) == ("slug", 1, 6, False)
