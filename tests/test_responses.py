"""Every report as a bounded response: meta first, an array that is never torn, the whole stream in a file if it does not fit."""

import json

import pytest
from pyspark.sql import functions as F

from threadmill import model
from threadmill.api import Sessions
from threadmill.operators import budget, slicing
from threadmill.plans import reports
from threadmill.sources import logs


@pytest.fixture
def store(spark, tmp_path):
    for name, n in (("aa", 30), ("bb", 2)):
        d = tmp_path / "logs" / f"session_20260101_000000_{name}"
        d.mkdir(parents=True)
        rows = [{"role": "user" if i % 2 else "assistant", "content": f"{name} says {i} " + "é" * (i % 7)} for i in range(n)]
        (d / "messages.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    return Sessions(spark, "vibe", str(tmp_path / "logs"))


def greedy(lines, most):
    kept, used = [], 1
    for line in lines:
        grown = used + bool(kept) + len(line.encode())
        if grown + 1 <= most:
            kept.append(line)
            used = grown
    return kept


@pytest.mark.parametrize(("tool", "options"), [("extract_messages", {"full": True}), ("extract_by_type", {"kinds": ["user"], "full": True}), ("said_did", {})])
def test_reports_respond_within_bounds(spark, store, tmp_path, tool, options):
    folder = str(tmp_path / "over")
    whole = {r.session_id[-2:]: r for r in store.respond(tool, 0, **options).collect()}
    got = {r.session_id[-2:]: r for r in store.respond(tool, 700, folder, **options).collect()}
    for name, r in got.items():
        every = json.loads(whole[name].response)
        assert not whole[name].overflow and whole[name].returned_bytes == whole[name].total_bytes == r.total_bytes and every[0]["type"] == "meta" and every[0]["tool"] == tool
        assert r.returned_bytes == len(r.response.encode()) <= 700 and json.loads(r.response)[0] == every[0]
        assert (r.records_total, r.total_lines) == (len(every) - 1, len(every)) and r.records_returned == len(json.loads(r.response)) - 1
        assert r.overflow == (name == "aa") and (r.full_report is None) == (name == "bb")
    stream = [r.value for r in spark.read.text(got["aa"].full_report).collect()]
    assert [json.loads(x) for x in stream] == json.loads(whole["aa"].response)
    assert json.loads(got["aa"].response) == [json.loads(x) for x in greedy(stream, 700)]


def test_limits_of_responses(store):
    with pytest.raises(ValueError, match="max_bytes"):
        store.respond("extract_messages", reports.CEILING + 1)
    with pytest.raises(ValueError, match="unknown report"):
        store.respond("nothing")


def test_period_report_has_its_nine_sections(spark, tmp_path):
    stream = [("a", 0, "user", "old", [], False), ("a", 1, "user", slicing.MARKER, [], True), ("a", 2, "assistant", "ok", ["bash: git commit -m x"], False), ("a", 3, "user", "steer", [], False), ("b", 0, "user", "hi", [], False)]
    m = spark.createDataFrame([(s, n, r, c, None, k, None, i) for s, n, r, c, k, i in stream], model.MESSAGES)
    item = lambda c, s="open": (c, s, None)
    flushes = spark.createDataFrame([("a", 1, "t1", [item("x")]), ("a", 2, "t2", [item("x"), item("y"), item("z")])], model.TODOS)
    listed = spark.createDataFrame([("a", "2026-01-02", 10, 4), ("b", "2026-01-01", 20, 1)], "session_id string, end_time string, file_size long, line_count long")
    (tmp_path / "plans").mkdir()
    (tmp_path / "plans" / "b.md").write_text("two")
    (tmp_path / "plans" / "a.md").write_text("one")
    (tmp_path / "plans" / "c.txt").write_text("no plan")
    meta, rows = reports.period_report(m, flushes, listed, slicing.is_marker("injected"), logs.plan_files(spark, str(tmp_path / "plans")))
    got = {}
    for r in rows.orderBy("session_id", "seq").collect():
        got.setdefault(r.session_id, {})[r.name] = r.text
    assert all(list(g) == list(reports.PERIOD) for g in got.values()) and set(got) == {"a", "b"}
    assert [line.split(" (")[0].rsplit("/", 1)[1] for line in got["a"]["plan_files"].split("\n")] == ["a.md", "b.md"] and "(3 bytes, mtime: 20" in got["a"]["plan_files"]
    log = got["a"]["todo_log"].split("\n")
    assert log[:3] == ["t1 added x", "t2 added y", "t2 added z"] and log[3] == "2 opened, 0 closed" and log[4:] == ["steer"]
    assert got["b"]["todo_log"] == reports.PERIOD["todo_log"] and got["b"]["commits"] == reports.PERIOD["commits"] and "git commit" in got["a"]["commits"]
    assert got["a"]["recent_rollouts"] == got["b"]["recent_rollouts"] and got["a"]["recent_rollouts"].count("\n") == 1
    assert "ok" in got["a"]["state_summary"] and "old" not in got["a"]["state_summary"] and "steer" in got["a"]["goals_summary"] and "since" in got["a"]["compaction_footer"]
    a = {r.session_id: r for r in meta.collect()}["a"]
    assert (a.session_messages_count, a.full_session_messages_count, a.user_messages_count, a.commits_in_period, a.todo_opens, a.todo_closes, a.todo_events, a.todo_writes, a.todo_baseline, a.rollout_table_rows) == (3, 4, 1, 1, 2, 0, 3, 2, 1, 2)
    assert a.state_prompt_bytes > 0 and a.goals_prompt_dropped_messages == 0


def test_the_fold_deals_its_records_itself(spark):
    """Over a union whose sides are dealt by the session, Spark leaves out a repartition by it and may then read the sides apart, so that
    a session's meta record and its messages meet two folds; the fold's own exchange must stay."""
    side = lambda: spark.range(40).select((F.col("id") % 9).cast("string").alias("session_id"), F.col("id").alias("seq"), F.lit(5).alias("len")).repartition("session_id")
    plan = budget.greedy_admission(side().unionByName(side()), 20, "len")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :].split("\n")[1:3]
    assert "Sort" in below[0] and "Exchange" in below[1]
