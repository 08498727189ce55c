"""Summary ledgers that grow: parts and rows of many sessions, written in an order that no failure can make untrue.

A folder holds three Parquet tables.  `parts` has the texts of summarised blocks, `rows` the ledger's rows, `deleted` the blocks that were
taken back; each row names the run that wrote it.  An append writes its parts, and when these are there its rows.  A row whose part
is missing therefore never exists; a part without a row, left by a run that failed in between, is not seen by anyone.  A rerun of the
same blocks writes what is missing and skips what has its row already."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill import model
from threadmill.operators.summary import valid_ledger

ROWS = f"{model.LEDGER}, run string, written_at timestamp"
PARTS = "session_id string, from_id long, run string, text string"
DELETED = "session_id string, from_id long, run string"


def _stored(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of all sessions with their run.  Of two runs that both wrote a session's block the first counts; a session with a malformed
    row has none."""
    gone = _stored(spark, folder, "deleted", DELETED)
    rows = _stored(spark, folder, "rows", ROWS).join(gone, ["session_id", "from_id", "run"], "left_anti")
    names = [c for c in rows.columns if c not in ("session_id", "from_id")]
    first = rows.groupBy("session_id", "from_id").agg(F.min_by(F.struct(*names), F.struct("written_at", "run")).alias("r"))
    return valid_ledger(first.select("session_id", "from_id", *(f"r.{c}" for c in names)))


def expected(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, expected_from_id) of the sessions that have blocks."""
    return ledger(spark, folder).groupBy("session_id").agg((F.max("to_id") + 1).alias("expected_from_id"))


def append(blocks: DataFrame, folder: str) -> DataFrame:
    """Append one block per session (the ledger's columns without part_file, and text): (session_id, from_id, run) of what was written.

    A block must begin at the id that its session's ledger expects, 1 at first; if any does not, nothing is written and the sessions are
    named.  A block that is there already, from and to the same ids, is skipped."""
    spark, run = blocks.sparkSession, uuid.uuid4().hex
    have = ledger(spark, folder).select("session_id", "from_id", "to_id", F.lit(True).alias("there"))
    new = blocks.join(have, ["session_id", "from_id", "to_id"], "left").filter("there is null").drop("there")
    new = new.join(expected(spark, folder), "session_id", "left").withColumn("expected_from_id", F.coalesce("expected_from_id", F.lit(1)))
    twice = F.count("*").over(_session()) > 1
    wrong = new.withColumn("twice", twice).filter((F.col("from_id") != F.col("expected_from_id")) | F.col("twice") | (F.col("to_id") < F.col("from_id")) | F.col("from_ts").isNull())
    bad = wrong.select("session_id", "from_id", "expected_from_id").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r['session_id']}: from_id must be {r['expected_from_id']}, not {r['from_id']}, in one block with a timestamp" for r in bad))
    new.select("session_id", "from_id", F.lit(run).alias("run"), "text").write.mode("append").parquet(f"{folder}/parts")
    written = _stored(spark, folder, "parts", PARTS).filter(F.col("run") == run)
    # rows follow the parts that are there, so a source that changes between both writes cannot leave a row without its part
    rows = new.join(written.select("session_id", "from_id"), ["session_id", "from_id"], "left_semi")
    name = F.format_string("part_%03d_%03d", "from_id", "to_id")
    columns = [f.strip().split(" ")[0] for f in model.LEDGER.split(",")]
    rows.withColumns({"part_file": name, "run": F.lit(run), "written_at": F.current_timestamp()}).select(*columns, "run", "written_at").write.mode("append").parquet(f"{folder}/rows")
    return written.select("session_id", "from_id", "run")


def _session():
    from pyspark.sql import Window as W

    return W.partitionBy("session_id")


def delete_latest(spark: SparkSession, folder: str, only: DataFrame) -> None:
    """Take back the last block of the sessions `only` (session_id).  The rows stay; what is taken back is named by its run, so a block
    that is appended in its place counts."""
    last = ledger(spark, folder).join(only.select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(F.max_by(F.struct("from_id", "run"), "to_id").alias("r"))
    last.select("session_id", "r.from_id", "r.run").write.mode("append").parquet(f"{folder}/deleted")


def compose(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, blocks, text): each session's parts, oldest first, each below a line that names its ids and times."""
    rows = ledger(spark, folder).join(_stored(spark, folder, "parts", PARTS), ["session_id", "from_id", "run"], "left")
    at = F.array_sort(F.collect_list(F.struct("from_id", "to_id", "from_ts", "to_ts", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "").alias("text"))))
    head = lambda b, i: F.format_string("### part %d: %s → %s (ids %d..%d)\n\n%s", i + 1, b["from_ts"], b["to_ts"], b["from_id"], b["to_id"], b["text"])
    return rows.groupBy("session_id").agg(F.count("*").alias("blocks"), F.array_join(F.transform(at, head), "\n\n").alias("text"))
