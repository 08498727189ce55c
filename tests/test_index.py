"""The persisted index: the same hits as a scan, from the buckets of the query's terms alone; what is missing is named."""

import glob
import json
import math
import os
import random
import re
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadmill.api import Sessions
from threadmill.operators import index, search

RND = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "eta", "Été", "日本", "x1"]
SCHEMA = "session_id string, seq long, role string, content string, thinking string, timestamp string"


def said():
    text = lambda n: " ".join(RND.choice(WORDS) for _ in range(RND.randint(0, n)))
    rows = [(f"s{i % 5}", i, RND.choice(["user", "assistant"]), text(12), RND.choice([None, "", text(6)]), None) for i in range(120)]
    return [*rows, ("empty", 0, "user", "", None, None), ("blank", 0, "user", "  ", None, None)]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(said(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(messages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    assert {r.session_id: r.doc_count for r in index.index_messages(messages, path, buckets=8).collect()}["empty"] == 0
    return path


def hits(df):
    return [(r.session_id, r.seq, round(r.score, 4), r.fragment, r.in_thinking, r.hit_rank) for r in df.collect()]


QUERIES = ["+alpha -beta", '(alpha OR "beta gamma") AND delta', "été 日本", "nowhere"]


@pytest.mark.parametrize("query", QUERIES)
def test_index_equals_scan(spark, messages, folder, query):
    assert hits(index.search_index(spark, folder, query)) == hits(search.search(messages, query))


def test_only_the_buckets_of_the_terms_are_read(spark, folder):
    live = index.committed(spark, folder).filter("doc_count > 0")
    found = index.matches(spark, folder, '"alpha beta" -delta', live)
    asked = {index.bucket_of(t, 8) for t in ("alpha", "beta", "delta")}
    read = {int(m) for m in re.findall(r"/postings/bucket=(\d+)/", " ".join(found.inputFiles()))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|INSET)", plan) and "PushedFilters: [In(term" in plan
    assert index._read(spark, folder, sorted(asked), live.select("session_id", "run")).filter(~F.col("bucket").isin(sorted(asked))).isEmpty()
    assert len(glob.glob(f"{folder}/postings/bucket=*")) > len(asked) and asked <= read


class Model:
    """A query's meaning, told by hand from its tree."""

    def __init__(self, tokens):
        self.tokens = tokens

    def run(self, terms):
        return any(self.tokens[i : i + len(terms)] == terms for i in range(len(self.tokens)))

    def holds(self, clauses):
        of = {m: [self.run(n) if isinstance(n[0], str) else self.holds(n) for k, n in clauses if k == m] for m in ("must", "should", "not")}
        return (all(of["must"]) if of["must"] else any(of["should"])) and not any(of["not"])


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("a b", [("should", ["a"]), ("should", ["b"])]),
        ("+a -b c", [("must", ["a"]), ("not", ["b"]), ("should", ["c"])]),
        ('(a OR b) AND "c d" -e', [("should", [("must", [("should", ["a"]), ("should", ["b"])]), ("must", ["c", "d"])]), ("not", ["e"])]),
        ("a AND b OR c", [("should", [("must", ["a"]), ("must", ["b"])]), ("should", ["c"])]),
        ("a AND NOT b", [("should", [("must", ["a"]), ("not", ["b"])])]),
        ("-(a b) ((c))", [("not", [("should", ["a"]), ("should", ["b"])]), ("should", [("should", [("should", ["c"])])])]),
    ],
)
def test_query_trees(query, tree):
    assert search.parse_query(query) == tree


@pytest.mark.parametrize("query", ["AND (", "(a", "a)", 'a "b', "a OR", "NOT", "", "-a", "OR a", "a AND OR b", "+ -"])
def test_what_is_no_query_raises(query):
    with pytest.raises(ValueError):
        search.parse_query(query)


def test_random_queries_against_brute_force(spark, messages, folder):
    def group(depth):
        parts = []
        for n in range(RND.randint(1, 3)):
            leaf = RND.choice([RND.choice(WORDS), f'"{RND.choice(WORDS)} {RND.choice(WORDS)}"'])
            node = f"({group(depth - 1)})" if depth and RND.random() < 0.4 else leaf
            parts.append((RND.choice([" AND ", " OR ", " "]) if n else "") + RND.choice(["", "", "+", "-"]) + node)
        return "".join(parts)

    rows = [(r.session_id, r.seq, [t for t in re.split(r"[\W_]+", f"{r.content or ''} {r.thinking or ''}".lower()) if t]) for r in messages.collect()]
    tried = 0
    while tried < 3:
        query = group(2)
        try:
            tree = search.parse_query(query)
        except ValueError:
            continue
        tried += 1
        want = {(s, n) for s, n, t in rows if Model(t).holds(tree)}
        assert {(r.session_id, r.seq) for r in index.search_index(spark, folder, query, hits=1000).collect()} == want, query


def test_sessions_are_replaced_and_failed_runs_are_not_seen(spark, messages, tmp_path):
    path, new = str(tmp_path / "i"), spark.createDataFrame([("s1", 0, "user", "zebra alpha", None, None)], SCHEMA)
    index.index_messages(messages, path)
    index.index_messages(new, path)
    index.index_messages(new, path)
    assert [(r.session_id, r.seq) for r in index.search_index(spark, path, "zebra").collect()] == [("s1", 0)]
    want = hits(search.search(messages.filter("session_id <> 's1'").union(new), "alpha"))
    assert hits(index.search_index(spark, path, "alpha")) == want
    # a run that fails behind the postings leaves rows without a commit
    before = set(glob.glob(f"{path}/commits/*"))
    index.index_messages(spark.createDataFrame([("s1", 5, "user", "yak", None, None)], SCHEMA), path)
    for f in set(glob.glob(f"{path}/commits/*")) - before:
        os.remove(f)
    assert hits(index.search_index(spark, path, "alpha")) == want and not hits(index.search_index(spark, path, "yak"))
    index.compact(spark, path, str(tmp_path / "j"))
    assert hits(index.search_index(spark, str(tmp_path / "j"), "alpha")) == want
    assert spark.read.parquet(f"{tmp_path}/j/docs").count() < spark.read.parquet(f"{path}/docs").count()
    with pytest.raises(ValueError, match="64 buckets"):
        index.index_messages(new, path, buckets=8)


def test_what_cannot_be_searched_is_named(spark, messages, tmp_path):
    path, none = str(tmp_path / "i"), spark.createDataFrame([], "id string")
    index.index_messages(messages.filter("session_id <> 's2'"), path)
    every = messages.select("session_id").distinct()
    meta, found = index.search_report(spark, path, "alpha", every, none)
    r = meta.first()
    assert r.not_indexed == ["s2"] and r.corrupt == [] and r.sessions_searched == 7 and r.sessions_with_hits == 4 and found.count() > 0
    meta, found = index.search_report(spark, path, "AND (", every, none)
    assert len(meta.first().corrupt) == 7 and "invalid query" in meta.first().corrupt[0] and found.count() == 0
    with pytest.raises(ValueError, match="empty"):
        index.search_report(spark, path, "  ", every, none)
    broken = f"{path}/postings/bucket={index.bucket_of('alpha', index.BUCKETS)}"
    for f in glob.glob(f"{broken}/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"no parquet")
    meta, found = index.search_report(spark, path, "alpha", every, none)
    assert [c.split(":")[0] for c in meta.first().corrupt] == ["s0", "s1", "s3", "s4"] and found.count() == 0
    assert index.search_report(spark, path, "beta", every, none)[0].first().corrupt == []


def test_stores_index_what_is_stale(spark, tmp_path):
    root, path = tmp_path / "logs", str(tmp_path / "i")
    for i in range(3):
        d = root / f"session_2026010{i + 1}_000000_a{i}"
        d.mkdir(parents=True)
        (d / "messages.jsonl").write_text(json.dumps({"role": "user", "content": f"alpha {i}"}) + "\n")
        (d / "meta.json").write_text("{}")
    s = Sessions(spark, "vibe", str(root))
    meta, found = s.search_index(path, "alpha")
    assert found.count() == 3 and meta.first().not_indexed == []
    one = root / "session_20260102_000000_a1"
    (one / "messages.jsonl").write_text(json.dumps({"role": "user", "content": "omega"}) + "\n")
    os.utime(one / "messages.jsonl", (datetime(2030, 1, 1).timestamp(),) * 2)
    again = Sessions(spark, "vibe", str(root))
    assert again.search_index(path, "alpha")[1].count() == 2 and again.search_index(path, "omega")[1].count() == 1
    meta, found = again.search_index(path, "alpha", ids=["a2", "nope"])
    assert meta.first().unmatched == ["nope"] and [r.session_id for r in found.collect()] == ["session_20260103_000000_a2"]


def test_databases_are_indexed_when_asked(spark, tmp_path):
    path = str(tmp_path / "opencode.db")
    c = sqlite3.connect(path)
    c.executescript("CREATE TABLE session(id TEXT PRIMARY KEY, parent_id TEXT, directory TEXT, title TEXT, time_created INT, time_updated INT); CREATE TABLE message(id TEXT PRIMARY KEY, session_id TEXT, time_created INT, time_updated INT, data TEXT); CREATE TABLE part(id TEXT PRIMARY KEY, message_id TEXT, session_id TEXT, time_created INT, time_updated INT, data TEXT)")
    c.execute("INSERT INTO session VALUES ('s1', NULL, '/w', 'T', 1, 2)")
    c.execute("""INSERT INTO message VALUES ('m1', 's1', 1, 1, '{"role":"user"}')""")
    c.execute("""INSERT INTO part VALUES ('p1', 'm1', 's1', 1, 1, '{"type":"text","text":"alpha"}')""")
    c.commit()
    c.close()
    s = Sessions(spark, "opencode", path)
    meta, found = s.search_index(str(tmp_path / "i"), "alpha")
    assert meta.first().not_indexed == ["s1"] and found.count() == 0
    s.index(str(tmp_path / "i"))
    meta, found = s.search_index(str(tmp_path / "i"), "alpha")
    assert meta.first().not_indexed == [] and found.count() == 1


def test_scores_keep_their_digits(spark):
    """A score rounds to the digits of the sum itself, as SQL's does, not to those of a float near it."""
    rows = [("a", i, None, "user", "lock " * (i + 1) + "word " * (3 * i)) for i in range(40)]
    m = spark.createDataFrame([(*r, None, [], False) for r in rows], "session_id string, seq long, timestamp string, role string, content string, thinking string, tool_calls_summary array<string>, injected boolean")
    got = {r["seq"]: r["score"] for r in search.search(m, "lock", hits=40).collect()}
    avg = sum(4 * i + 1 for i in range(40)) / 40
    want = {i: math.log(1 + 0.5 / 40.5) * (i + 1) * 2.2 / (i + 1 + 1.2 * (0.25 + 0.75 * (4 * i + 1) / avg)) for i in range(40)}
    assert got == pytest.approx(want, rel=1e-12)
