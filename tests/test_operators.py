import random

from pyspark.sql import functions as F

from threadmill import model
from threadmill.functions import text
from threadmill.operators import budget, dedupe, entries, index, maintain, profile, qa, search, slicing, summary, todos
from threadmill.plans import prompts, reports


def stream(spark, rows):
    """rows: (session, seq, role, content[, calls[, thinking[, injected]]])."""
    full = [(s, i, r, c, x[1] if len(x) > 1 else None, x[0] if x else [], f"2024-01-01T00:00:{i:02d}Z", x[2] if len(x) > 2 else False) for s, i, r, c, *x in rows]
    return spark.createDataFrame(full, model.MESSAGES)


def test_greedy_admission_equals_a_fold(spark):
    rnd = random.Random(3)
    rows = [(s, i, rnd.randint(1, 60)) for s in range(20) for i in range(12)]
    df = spark.createDataFrame(rows, "session_id long, seq long, len long")
    got = {(r.session_id, r.seq): r.admitted for r in budget.greedy_admission(df, 150, "len").collect()}
    for s in range(20):
        used, n = 1, 0
        for i in range(12):
            size = next(x for a, b, x in rows if (a, b) == (s, i))
            ok = used + (n > 0) + size + 1 <= 150
            used, n = (used + (n > 0) + size, n + 1) if ok else (used, n)
            assert got[s, i] == ok


def test_todo_events_equal_a_fold(spark):
    rnd, rows, want = random.Random(5), [], []
    key = lambda c: c.split()[0] if c.startswith("item") else c
    for s in range(30):
        prev: list[tuple[str, str]] = []
        for f in range(6):
            now = [(f"item{rnd.randint(1, 4)}: {rnd.choice('ab')}" if rnd.random() < 0.6 else rnd.choice("xyz"), rnd.choice(["open", "completed"])) for _ in range(rnd.randint(0, 5))]
            rows.append((str(s), f, None, now))
            for pos, (c, st) in enumerate(now):
                was = next((p for p in prev if key(p[0]) == key(c)), None)
                action = "added" if was is None else st if was[1] != st else "updated" if was[0] != c else None
                if action:
                    want.append((str(s), f + 1, 0, pos, "0", action, c, st))
            want += [(str(s), f + 1, 1, pos, "0", "removed", c, None) for pos, (c, _) in enumerate(prev) if key(c) not in {key(x) for x, _ in now}]
            prev = now
    df = spark.createDataFrame([(s, f, t, [{"content": c, "status": x, "priority": None} for c, x in now]) for s, f, t, now in rows], model.TODOS)
    got = [tuple(r) for r in todos.todo_events(df).select("session_id", "nth", "phase", "pos", "ts", "action", "todo", "status").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_tail_budget_drops_all_that_is_older(spark):
    m = stream(spark, [("a", 0, "user", "x" * 10), ("a", 1, "user", "y" * 200), ("a", 2, "user", ""), ("a", 3, "user", "z" * 10), ("b", 0, "user", "one\n" + "w" * 40 + "\nlast")])
    got = [(r.session_id, r.seq, r.content) for r in budget.tail_budget(m, budget.RESERVE + 20, "content").orderBy("session_id", "seq").collect()]
    assert got == [("a", 3, "z" * 10), ("b", 0, "last")]


def test_pages_cover_the_whole(spark):
    m = stream(spark, [("a", i, "user", str(i)) for i in range(7)])
    got = [r.seq for k in range(0, 9, 3) for r in slicing.page(m, 3, k).orderBy("seq").collect()]
    assert got == list(range(7)) and [r.seq for r in slicing.page(m, 2).orderBy("seq").collect()] == [5, 6]


def test_entries_and_derived_ones(spark):
    m = stream(spark, [("a", 0, "user", "hi"), ("a", 1, "assistant", "yo", [], "hm"), ("a", 2, "system", "no"), ("a", 3, "user", "c", [], None, True), ("a", 4, "tool", "t")])
    e = entries.typed_entries(m)
    assert [(r.idx, r.entry_type) for r in e.orderBy("idx").collect()] == [(0, "user"), (1, "assistant"), (2, "thinking"), (3, "tool")]
    d = m.filter("injected").select("session_id", F.col("seq").alias("n"), "timestamp", F.lit("{}").alias("record"))
    assert [(r.idx, r.entry_type) for r in entries.with_derived(e, {"compaction": d}).orderBy("idx").collect()][-1] == (4, "compaction")
    assert entries.check_kinds(["all"]) == list(entries.KINDS)


def test_events_of_interest_and_gaps(spark):
    m = stream(spark, [("a", 0, "user", "hi"), ("a", 4, "assistant", "", ["bash: git commit -m x && git push", "todo(write)"]), ("a", 6, "user", slicing.MARKER, [], None, True)])
    shown = lambda h: [(r.line_number, r.event_type, r.gap_lines) for r in profile.interesting_events(m, h).orderBy("line_number", "sub").collect()]
    assert shown("vibe") == [(1, "UserMessage", 1), (5, "GitCommit", 4), (5, "GitPush", 0), (5, "TodoCreate", 0), (7, "Compaction", 2)]
    assert shown("opencode") == [(1, "UserMessage", 1), (5, "GitCommit", 4), (7, "Compaction", 2)]
    assert [x[1] for x in shown("mock")] == ["GitCommit", "GitPush", "TodoCreate", "Compaction"]


def test_question_pairs(spark):
    q = lambda *t: [{"question": x, "header": None, "options": []} for x in t]
    rows = [("a", 0, None, q("x", "y"), [{"question": "y", "answer": "1"}, {"question": None, "answer": "2"}]), ("b", 0, None, [], [{"question": None, "answer": "z"}]), ("c", 0, None, q("only"), [])]
    df = spark.createDataFrame(rows, "session_id string, seq long, timestamp string, questions array<struct<question:string,header:string,options:array<struct<label:string,description:string>>>>, records array<struct<question:string,answer:string>>")
    assert sorted((r.session_id, r.question, r.answer) for r in qa.pair_answers(df).collect()) == [("a", "x", "1"), ("a", "y", "1"), ("b", "", "z")]
    assert spark.range(1).select(qa.parse_questions(F.lit('{"questions":[{"question":"q","options":[{"label":"l"}]},{}]}'))).first()[0][0]["options"][0]["label"] == "l"


def test_search(spark):
    m = stream(spark, [("a", 0, "user", "alpha beta"), ("a", 1, "user", "beta gamma"), ("a", 2, "assistant", "", [], "hidden alpha"), ("b", 0, "user", "ALPHA alpha, alpha!"), ("b", 1, "user", "")])
    got = search.search(m, "alpha").collect()
    assert {(r.session_id, r.seq, r.in_thinking) for r in got} == {("a", 0, False), ("a", 2, True), ("b", 0, False)} and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert [(r.session_id, r.seq) for r in search.search(m, '"beta gamma"').collect()] == [("a", 1)]
    assert [(r.session_id, r.seq) for r in search.search(m, "beta -gamma").collect()] == [("a", 0)]
    assert {(r.session_id, r.seq) for r in search.search(m, "beta AND alpha").collect()} == {("a", 0)}
    told = m.filter("content <> ''").select("session_id", F.lit("r").alias("run"), "seq", F.lit(3).alias("len"), text.query_tokens("content").alias("t"))
    assert index.postings(told, 4).filter("term = 'alpha' and session_id = 'b'").first().places == [0, 1, 2]


def test_aliases_and_chunk_merge(spark):
    s = spark.createDataFrame([("x", 1, 5), ("y", 1, 2), ("z", 2, 9)], "session_id string, size long, d long")
    assert sorted(tuple(r) for r in dedupe.aliases(s, ["size"], "d").collect()) == [(1, "y", ["x"]), (2, "z", [])]
    rows = [("s", "turn", "1", "user", "hello there", 2, "p", 0), ("s", "turn", "1", "user", "dup", 3, "p", 1), ("s", "history", None, "user", "hello there ", 1, "q", 0), ("s", "history", None, "user", "other", 1, "q", 1), ("s", "history", None, "assistant", "no", 1, "q", 2)]
    df = spark.createDataFrame(rows, "session_id string, source string, id string, role string, content string, sort_key long, path string, pos int")
    assert [(r.seq, r.content) for r in dedupe.merge_chunks(df).orderBy("seq").collect()] == [(0, "other"), (1, "hello there")]


def test_ledger(spark):
    m = stream(spark, [("a", i, "user", "word " * 4) for i in range(5)])
    block = lambda a, b, s="a": (s, a, b, None, None, 0, 0, 0, 0, 0, 0, "f")
    ledger = spark.createDataFrame([block(1, 2), block(3, 3), block(5, 4, "bad"), block(1, 2, "bad")], model.LEDGER)
    r = summary.status(ledger, m).first()
    assert (r.blocks, r.through_id, r.expected_from_id, r.tail_user, r.tail_tokens_est) == (2, 3, 4, 2, 10)
    assert summary.valid_ledger(ledger).select("session_id").distinct().collect()[0][0] == "a"
    assert [x.to_id for x in summary.delete_latest(ledger.filter("session_id = 'a'")).collect()] == [2]
    made = summary.summarise(m, ledger.filter("session_id = 'a'"), 4, lambda what, text: f"{len(text)}")
    assert (made["from_id"], made["to_id"]) == (4, 5)


def test_prune_keeps_by_number(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, seq long")
    kept, gone = maintain.prune(df, "g", "seq", 1)
    assert kept.count() == 3 and gone.count() == 0


def test_prompts_are_bounded(spark):
    m = stream(spark, [("a", i, "user", f"{i} " + "x" * 300) for i in range(40)])
    r = prompts.bounded_prompt(m, 2_000).first()
    assert r.bytes <= 2_000 and r.dropped_items > 30 and r.text.rstrip().endswith("x")


def test_reports(spark):
    m = stream(spark, [("a", 0, "user", "old"), ("a", 1, "user", slicing.MARKER, [], None, True), ("a", 2, "assistant", "ok", ["bash: git commit -m x"]), ("a", 3, "user", "next")])
    mark = slicing.is_marker("injected")
    meta, rows = reports.extract_messages(m, mark)
    assert [r.seq for r in rows.orderBy("seq").collect()] == [1, 2, 3] and meta.first().total == 3
    kept, total = reports.sink(rows.select("session_id", "seq", "json"), 260)
    assert 0 < kept.count() < 3 and total.first().records == 3
    assert [r.kind for r in reports.said_did(m, mark).orderBy("section", "seq", "pos").collect()] == ["he_said", "he_said", "she_said", "compaction_boundary", "they_did"]
    none = spark.createDataFrame([], model.TODOS)
    meta, sections = reports.prior_period(m, none, spark.createDataFrame([("a", "2024")], "session_id string, end_time string"), mark)
    assert {r.section for r in sections.collect()} == {"state", "goals", "steers", "rollouts", "commits", "compactions"} and meta.first().commits == 1
