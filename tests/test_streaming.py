import json
import os
import random

from pyspark.sql import functions as F

from threadmill.operators import todos
from threadmill.streaming import batches, sessions


def run(spark, df, name, tmp_path, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    src = tmp_path / "in"
    table.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").repartition(3).write.parquet(str(src))
    stored = spark.read.parquet(str(src))
    stream = spark.readStream.schema(stored.schema).parquet(str(src))
    got = run(spark, sessions.late_hourly(stream), "hourly", tmp_path, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batches.hourly(stored).collect()))


def test_log_folder(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([json.dumps({"role": "user"}), "", "{bad", json.dumps({"role": "user"})]))
    got = run(spark, sessions.role_counts(sessions.message_lines(spark, str(folder))), "roles", tmp_path, "complete").collect()
    assert [(r.role, r.n) for r in got] == [("user", 2)]


TODOS = "session_id string, flush long, timestamp string, todos array<struct<content:string,status:string,priority:string>>"


def snapshots():
    item = lambda c, s="open": (c, s, None)
    a = [[item("a"), item("item1: x")], [item("a", "done"), item("item1: y"), item("b")], [], [item("b"), item("b", "done"), item("item1: z", "done")], [item("item1: z", "done"), item("item2.1: q", None)], [item("item2.1: r", None)]]
    b = [[item("p")], [item("p")], [item("q"), item("p", "cancelled")]]
    return [(s, n + 1, f"t{n}" if n % 2 else None, todos) for s, flushes in (("s", a), ("u", b)) for n, todos in enumerate(flushes)]


def fed(spark, rows, schema, name, tmp_path, made):
    """The stream `made` of rows that come one file, and so one batch, after the other."""
    src = tmp_path / f"{name}-in"
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(src / f"{n:03d}"))
        for f in (src / f"{n:03d}").glob("part-*"):
            os.utime(f, (1_000_000_000 + n,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src / "*"))
    return [tuple(r) for r in run(spark, made(stream), name, tmp_path).collect()]


def test_todo_state_equals_batch_in_any_order(spark, tmp_path):
    rows = snapshots()
    batch = todos.todo_events(spark.createDataFrame(rows, TODOS)).select("session_id", F.col("nth").cast("long"), "phase", "pos", "ts", "action", "todo", "status")
    want = sorted(map(repr, map(tuple, batch.collect())))
    assert any("updated" in w for w in want) and any("removed" in w for w in want)
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    for name, parts in (("ordered", [rows]), ("split", [shuffled[0:3], shuffled[3:4], shuffled[4:], rows[:2]])):
        assert sorted(map(repr, fed(spark, parts, TODOS, name, tmp_path, sessions.todo_changes))) == want


def test_coverage_accepts_what_follows(spark, tmp_path):
    schema = "session_id string, from_id long, to_id long"
    parts = [[("a", 3, 4), ("b", 2, 2)], [("a", 1, 2), ("a", 4, 9)], [("a", 5, 5), ("a", 9, 8), ("b", 1, 1)]]
    got = fed(spark, parts, schema, "cover", tmp_path, sessions.coverage)
    assert sorted(r[:4] for r in got) == [("a", 1, 2, True), ("a", 3, 4, True), ("a", 4, 9, False), ("a", 5, 5, True), ("a", 9, 8, False), ("b", 1, 1, True), ("b", 2, 2, True)]
    assert max(r[4] for r in got if r[0] == "a") == 6 and max(r[4] for r in got if r[0] == "b") == 3
