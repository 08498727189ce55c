import json

from threadmill.api import Sessions
from threadmill.operators import qa
from threadmill.sources import jsonl

ASKED = {"questions": [{"question": "Where?", "header": "Target", "options": [{"label": "Here", "description": "near"}, {"label": "There"}, {"description": "no label"}]}, {"question": "Why?"}, {"header": "no question"}]}


def message(spark, rows):
    return spark.createDataFrame([("s", i, role, content, None, calls, f"t{i}", False) for i, (role, content, calls) in enumerate(rows)], "session_id string, seq long, role string, content string, thinking string, tool_calls_summary array<string>, timestamp string, injected boolean")


def test_pairs_of_messages(spark):
    args = json.dumps(ASKED)
    rows = [("assistant", "", ["bash: ls", f"question({args})"]), ("user", "hm", []), ("tool", "answers: [{'question': 'Why?', 'answer': 'so'}, {'question': 'Else', 'answer': 'x'}]", []),
            ("assistant", "", [f"ask_user_question({args})"]), ("tool", "answers: [{'answer': 'a'}] cancelled: true", []), ("assistant", "", ["question(broken"]), ("tool", "answers: [{'answer': 'only'}]", []), ("assistant", "", [f"question({args})"])]
    got = [(r.seq, r.nth, r.pos, r.question, r.answer) for r in qa.pairs_of_messages(message(spark, rows)).orderBy("seq", "nth", "pos").collect()]
    assert got == [(0, 1, 0, "Where?", "so"), (0, 1, 1, "Why?", "so"), (5, 0, 0, "question(broken", "only")]


def test_questions_of_a_store(spark, tmp_path):
    d = tmp_path / "session_20260101_000000_aa"
    d.mkdir()
    call = lambda i: {"role": "assistant", "timestamp": f"c{i}", "tool_calls": [{"id": i, "function": {"name": "ask_user_question", "arguments": json.dumps(ASKED)}}]}
    rows = [call("1"), {"role": "tool", "tool_call_id": "1", "content": "answers: [{'question': 'Why?', 'answer': 'old'}]"}, {"role": "tool", "tool_call_id": "1", "timestamp": "a1", "tool_result": {"output": {"answers": [{"question": "Why?", "answer": "so"}, {"question": "Where?", "answer": "Here"}, {"question": "no answer"}]}}},
            call("2"), {"role": "tool", "tool_call_id": "2", "content": "cancelled: true answers: [{'answer': 'x'}]"}, call("3"), {"role": "user", "content": "context compaction", "injected": True}, call("4"), {"role": "tool", "tool_call_id": "4", "content": "answers: [{'answer': 'z'}]"}]
    (d / "messages.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    s = Sessions(spark, "vibe", str(tmp_path))
    found = [json.loads(r.record) for r in s.entries(["questions"], full=True)[1].orderBy("idx").collect()]
    found = [r.get("record", r) for r in found]
    assert [(r["question"], r["answers"], r.get("timestamp")) for r in found] == [("Where?", ["Here"], "a1"), ("Why?", ["so"], "a1"), ("Where?", ["z"], "c4")]
    assert found[0]["header"] == "Target" and found[0]["options"] == [{"label": "Here", "description": "near"}, {"label": "There", "description": ""}]
    assert s.entries(["questions"])[1].count() == 1
    assert [r.line_number for r in s.profile()[1].orderBy("line_number").collect()] and s.messages.agg({"line": "max"}).first()[0] == 17


def test_line_numbers_of_split_files(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 3)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"n": i}) + "\n" + ("\n" if i % 7 == 0 else "") for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {(r.path[-7], r.line): json.loads(r.raw)["n"] for r in jsonl.lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, n in (("a", 5000), ("b", 3)):
        text = (tmp_path / f"{name}.jsonl").read_text().split("\n")
        assert {(name, i + 1): json.loads(x)["n"] for i, x in enumerate(text) if x}.items() <= got.items()
    assert len(got) == 5003
