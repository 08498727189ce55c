"""Stored results: summary ledgers and profiles, and when they are still fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill import model
from threadmill.operators.summary import valid_ledger

_LEDGER = [f.strip().split(" ") for f in model.LEDGER.split(",")][1:]
SLACK_SECONDS = 15


def read_ledger(spark: SparkSession, paths: str | list[str], session: str = r"([^/]+)/ledger\.csv$") -> DataFrame:
    """Ledgers in CSV (11 columns, no header); session: the pattern of the id in the path.  One malformed row (a short
    one, a number that is none, to_id before from_id) voids its whole ledger."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(paths).select(F.regexp_extract(F.col("_metadata.file_path"), session, 1).alias("session_id"), F.col("value"))
    f = F.split("value", ",")
    cells = [F.get(f, F.lit(i)) for i in range(len(_LEDGER))]
    typed = [(F.expr(f"try_cast(get(split(value, ','), {i}) AS BIGINT)") if kind == "long" else c).alias(name) for i, (c, (name, kind)) in enumerate(zip(cells, _LEDGER, strict=True))]
    rows = text.filter(F.trim("value") != "").select("session_id", F.size(f).alias("n"), *typed)
    fixed = rows.withColumn("part_file", F.when(F.col("n") == len(_LEDGER), F.col("part_file"))).drop("n")
    return valid_ledger(fixed)


def write_profiles(profiles: DataFrame, folder: str) -> None:
    """Keep profiles (session_id, line_count, ...), each session's as a whole.  A profile without an id, or with a negative count, is none: it
    raises before anything is written."""
    counts = [c for c, kind in profiles.dtypes if kind in ("int", "bigint") and c.endswith("_count")]
    bad = profiles.filter(" or ".join(["session_id is null", *(f"{c} is null or {c} < 0" for c in counts)]))
    if not bad.isEmpty():
        raise ValueError("a profile has no session or a count that is none")
    profiles.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(folder)


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The profiles that are kept; none if there is no folder yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    shape = "session_id string, line_count long, file_size long, user_count long, assistant_count long, tool_count long, has_compaction boolean, written_at timestamp"
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(folder)


def fresh(cached: DataFrame, updated: DataFrame) -> DataFrame:
    """Cached rows (session_id, written_at) whose session (session_id, mtime) has not changed since, give or take SLACK_SECONDS."""
    late: Column = F.col("mtime") <= F.col("written_at") + F.make_dt_interval(secs=F.lit(float(SLACK_SECONDS)))
    return cached.join(updated.select("session_id", "mtime"), "session_id").filter(late).drop("mtime")
