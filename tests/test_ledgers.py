"""Ledgers that survive a failure between their writes, profiles that are kept, native entries."""

import glob
import json
import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from threadmill.api import Sessions
from threadmill.sources import caches, jsonl, ledgers, logs

BLOCK = "session_id string, from_id long, to_id long, from_ts string, to_ts string, user long, assistant long, tool long, thinking long, chars long, tokens_est long, text string"


def block(session, low, high, text="t"):
    return (session, low, high, f"at{low}", f"at{high}", 1, 1, 0, 0, 10, 2, text)


@pytest.fixture
def blocks(spark):
    return lambda *rows: spark.createDataFrame(rows, BLOCK)


def shown(spark, folder):
    return sorted((r.session_id, r.from_id, r.to_id) for r in ledgers.ledger(spark, folder).collect())


def test_blocks_follow_each_other(spark, blocks, tmp_path):
    path = str(tmp_path / "l")
    ledgers.append(blocks(block("a", 1, 2, " one\n"), block("b", 1, 5)), path)
    ledgers.append(blocks(block("a", 3, 4, "two")), path)
    assert shown(spark, path) == [("a", 1, 2), ("a", 3, 4), ("b", 1, 5)]
    for wrong in (block("a", 4, 9), block("a", 6, 9), block("c", 2, 3), block("b", 6, 5), ("a", 5, 9, None, "x", 1, 1, 0, 0, 1, 1, "t")):
        with pytest.raises(ValueError, match="from_id must be"):
            ledgers.append(blocks(wrong, block("d", 1, 1)), path)
    with pytest.raises(ValueError, match="one block"):
        ledgers.append(blocks(block("a", 5, 6), block("a", 5, 7)), path)
    assert len(shown(spark, path)) == 3
    text = ledgers.compose(spark, path).filter("session_id = 'a'").first()
    assert (text.blocks, text.text) == (2, "### part 1: at1 → at2 (ids 1..2)\n\none\n\n### part 2: at3 → at4 (ids 3..4)\n\ntwo")
    ledgers.delete_latest(spark, path, spark.createDataFrame([("a",)], "session_id string"))
    assert shown(spark, path) == [("a", 1, 2), ("b", 1, 5)]
    ledgers.append(blocks(block("a", 3, 7, "again")), path)
    assert shown(spark, path) == [("a", 1, 2), ("a", 3, 7), ("b", 1, 5)]


def test_a_failure_between_both_writes_is_no_lie(spark, blocks, tmp_path):
    path, both = str(tmp_path / "l"), [block("a", 1, 2, "first"), block("b", 1, 1)]
    ledgers.append(blocks(*both), path)
    shutil.rmtree(f"{path}/rows")  # as if the run had ended behind its parts
    assert shown(spark, path) == [] and ledgers.compose(spark, path).count() == 0
    ledgers.append(blocks(*both), path)
    assert ledgers.append(blocks(*both), path).count() == 0  # a rerun adds nothing
    assert shown(spark, path) == [("a", 1, 2), ("b", 1, 1)]
    assert ledgers.compose(spark, path).filter("session_id = 'a'").first().text.endswith("first")
    assert spark.read.parquet(f"{path}/parts").count() == 4  # the orphans stay unseen


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "logs" / "session_20260101_000000_aa"
    d.mkdir(parents=True)
    lines = ['{"role" : "user",  "content":"a", "timestamp":"2026-01-01T00:00:00Z"}', "", "{broken", '{"role":"user","content":"a context compaction","injected":true,"odd":[1, 2]}', '{"content":"b","role":"assistant","timestamp":"2026-01-01T00:01:00Z", "x":  "é"}', '{"role":"system","content":"s"}', '{"role":"tool","content":"r","timestamp":"2026-01-01T00:02:00Z"}']
    (d / "messages.jsonl").write_text("\n".join(lines) + "\n")
    (d / "meta.json").write_text("{}")
    return str(tmp_path / "logs"), lines


def test_native_entries_are_the_lines(spark, root):
    folder, lines = root
    rows = jsonl.lines(spark, folder, "messages.jsonl")
    got = lambda **k: [(r.idx, r.entry_type, r.record) for r in logs.native_entries(rows, **k).orderBy("idx").collect()]
    assert got(full=True) == [(0, "user", lines[0]), (1, "assistant", lines[4]), (2, "tool", lines[6])]
    assert got() == [(0, "assistant", lines[4]), (1, "tool", lines[6])]
    assert got(include_injected=True) == [(0, "user", lines[3]), (1, "assistant", lines[4]), (2, "tool", lines[6])]
    meta, page = Sessions(spark, "vibe", folder).entries(["assistant", "compaction"], full=True)
    assert [json.loads(r.json)["record"] for r in page.filter("entry_type = 'assistant'").collect()] == [lines[4]]


def test_summaries_of_a_store(spark, root, tmp_path):
    s, path = Sessions(spark, "vibe", root[0]), str(tmp_path / "l")
    before = s.summary_status(path).first()
    assert (before.blocks, before.expected_from_id, before.tail_user) == (0, 1, 2)
    with pytest.raises(ValueError, match="from_id must be 1"):
        s.summarise_from(path, "aa", 2, lambda what, text: "no")
    out = s.summarise_from(path, "aa", 1, lambda what, text: f"kept {len(text) > 0}").first()
    assert out.blocks == 1 and re.search(r"ids 1\.\.5\)\n\nkept True$", out.text)
    after = s.summary_status(path).first()
    assert (after.blocks, after.through_id, after.expected_from_id, after.tail_user) == (1, 5, 6, 0)


def test_profiles_are_kept_while_they_are_true(spark, root, tmp_path):
    folder, cache = root[0], str(tmp_path / "p")
    first = Sessions(spark, "vibe", folder).cached_profiles(cache).first()
    assert first.line_count == 5
    log = glob.glob(f"{folder}/*/messages.jsonl")[0]
    stamp = os.stat(log).st_mtime
    with open(log, "a") as f:
        f.write('{"role":"user","content":"more"}\n')
    os.utime(log, (stamp, stamp))  # the file claims not to have changed, so the kept profile stands
    assert Sessions(spark, "vibe", folder).cached_profiles(cache).first().line_count == 5
    os.utime(log, (4_000_000_000,) * 2)
    assert Sessions(spark, "vibe", folder).cached_profiles(cache).first().line_count == 6
    with pytest.raises(ValueError, match="count that is none"):
        caches.write_profiles(spark.createDataFrame([("a", -1)], "session_id string, line_count long"), cache)
    assert caches.profiles(spark, cache).filter(F.col("session_id") == "a").isEmpty()
