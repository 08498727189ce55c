import json

import pytest

from threadmill.api import Sessions, check_window, resolve_root, store


@pytest.fixture
def root(tmp_path):
    for i, name in enumerate(("session_20260101_000000_aa", "session_20260102_000000_ab")):
        d = tmp_path / name
        d.mkdir()
        rows = [{"role": "user", "content": f"alpha {i}", "timestamp": f"2026-01-0{i + 1}T00:00:00Z"}, {"role": "user", "content": "context compaction", "injected": True}, {"role": "assistant", "content": "beta", "timestamp": f"2026-01-0{i + 1}T00:01:00Z"}]
        (d / "messages.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
        (d / "meta.json").write_text(json.dumps({"title": f"t{i}", "environment": {"working_directory": f"/Work/{i}"}}))
    return str(tmp_path)


def test_reports_of_a_store(spark, root):
    s = Sessions(spark, "mistral-vibe", root)
    rows = s.list().collect()
    assert len(rows) == 2 and all((r.user_count, r.assistant_count, r.has_compaction) == (2, 1, True) for r in rows) and {r.title for r in rows} == {"t0", "t1"}
    assert [r.title for r in s.list(directory="work/1").collect()] == ["t1"]
    assert {r.session_id: r.total for r in s.extract()[0].collect()} == {r.session_id: 2 for r in rows}
    assert s.user_messages()[1].count() == 2 and s.search("alpha").count() == 2 and s.said_did().count() == 6
    meta, found = s.entries(["user", "compaction"], full=True)
    assert found.count() == 4 and s.prompt().count() == 2 and s.profile()[1].count() == 4
    assert s.copies().count() == 2


def test_one_session(spark, root):
    s = Sessions(spark, "vibe", root, session="20260102")
    assert s.messages.select("session_id").distinct().count() == 1
    with pytest.raises(ValueError, match="todo history"):
        s.todo_flushes()


def test_validation(monkeypatch):
    with pytest.raises(ValueError, match="unknown store"):
        store("none")
    monkeypatch.setenv("CODEX_SESSIONS_DIR", "")
    with pytest.raises(ValueError, match="no root"):
        resolve_root("codex")
    monkeypatch.setenv("CODEX_SESSIONS_DIR", "/x")
    assert resolve_root("codex") == "/x" and resolve_root("codex", "/y") == "/y"
    assert check_window(None, True, 24) == 0 and check_window(0, False, 24) == 24
    with pytest.raises(ValueError, match="contradict"):
        check_window(5, True, 24)
