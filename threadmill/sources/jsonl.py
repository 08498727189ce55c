"""Line-oriented JSON logs: physical line numbers, damage kept apart from emptiness."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


@contextlib.contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While files are listed, a few tasks per core share the folders; by default each folder is a task of its own, which costs
    milliseconds for each of many small session folders.  The session's own setting comes back."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(int(was), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def whole_files(spark: SparkSession, paths: str | list[str], glob: str | None = None, only: Column | None = None) -> DataFrame:
    """(path, mtime, size, text) of every file, read as a whole because line numbers are part of the data; only: a condition on
    the files' metadata, by which they are left out unread."""
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    with few_listing_tasks(spark):
        raw = reader.text(paths, wholetext=True)
    raw = raw if only is None else raw.filter(only)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))


def file_stats(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, mtime, size) of every file; no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    with few_listing_tasks(spark):
        files = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def numbered_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, mtime, size, line, raw) of every line, with its 1-based physical number.  Files are split: a line's number is
    its place in its split behind the lines of the splits before, so no task holds a file and nothing is sorted."""
    return _numbered(_raw_lines(spark, paths, glob)).select("path", "mtime", "size", "line", "raw")


def _raw_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, mtime, size, split, id, raw) of every line; ids grow by one from line to line of a split."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    with few_listing_tasks(spark):
        raw = (reader.option("pathGlobFilter", glob) if glob else reader).text(paths)
    meta = {"path": "file_path", "mtime": "file_modification_time", "size": "file_size", "split": "file_block_start"}
    return raw.select(*(F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` with each line's 1-based number in its path."""
    from pyspark.sql import Window as W

    splits = rows.groupBy("path", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = splits.select("path", "split", "first", before.alias("before"))
    return rows.join(placed, ["path", "split"]).withColumn("line", (F.col("id") - F.col("first") + F.col("before") + 1).cast("long"))


def write_bundles(lines: DataFrame, folder: str, *order: str) -> None:
    """Write `lines` (path, order..., raw: a line each, null: a blank one) as bundles: text files that hold the lines of many logs, each behind
    its log's path, encoded as in a URL, and a tab.  A log's lines stand together in their order.  The files' number goes with the bytes,
    not with the logs, of which each would cost the file system and the driver milliseconds."""
    line = F.concat(F.url_encode("path"), F.lit("\t"), F.coalesce("raw", F.lit("")))
    lines.repartition(F.xxhash64("path")).sortWithinPartitions("path", *order).select(line.alias("value")).write.text(folder, lineSep="\n")


def bundled_numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, mtime, line, raw) of every line of the logs in bundles, with its 1-based number in its own log; mtime is the bundle's."""
    rows = _raw_lines(spark, paths).withColumn("split", F.struct(F.col("path").alias("file"), "split"))
    rows = rows.withColumns({"path": F.substring_index("raw", "\t", 1), "raw": F.expr("substring(raw, instr(raw, '\t') + 1)")})
    return _numbered(rows).select(F.url_decode("path").alias("path"), "mtime", "line", "raw")


def bundled_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, mtime, line, raw, rec): the same as `lines`, from bundles."""
    return parsed(bundled_numbered(spark, paths))


def bundled_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, mtime, text): the logs in bundles as whole files."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n")
    return bundled_numbered(spark, paths).groupBy("path").agg(F.max("mtime").alias("mtime"), text.alias("text"))


def parsed(numbered: DataFrame) -> DataFrame:
    """The lines that are not blank, with `rec`: null where the line is no JSON."""
    kept = numbered.withColumn("raw", F.make_valid_utf8("raw")).filter(F.trim("raw") != "")
    return kept.withColumn("rec", F.try_parse_json("raw"))


def lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, mtime, size, line, raw, rec): a row per line of the files that is not blank."""
    return parsed(numbered_lines(spark, paths, glob))


def damage(parsed: DataFrame) -> DataFrame:
    return parsed.filter("rec is null").select("path", "line", F.lit("not valid JSON").alias("error"))


def text_at(rec: Column | str, path: str) -> Column:
    """A string field; null if it is missing or no string."""
    got = F.try_variant_get(rec, path, "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(rec, path, "string"))


def items(rec: Column | str, path: str) -> Column:
    """An array field as an array of variants; empty if it is missing or no array."""
    return F.coalesce(F.try_variant_get(rec, path, "array<variant>"), F.array().cast("array<variant>"))


def texts_of(parts: Column, kinds: tuple[str, ...], field: str = "$.text") -> Column:
    """The texts of the parts whose type is one of `kinds`, a line each."""
    kept = F.filter(parts, lambda p: F.coalesce(text_at(p, "$.type").isin(*kinds), F.lit(False)))
    return F.array_join(F.filter(F.transform(kept, lambda p: text_at(p, field)), lambda t: t.isNotNull()), "\n")


def ordered(messages: DataFrame, *order: str) -> DataFrame:
    """The normalized columns, with `seq` numbered from 0 within each session by `order`, and the physical line if known."""
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("session_id").orderBy(*order)) - 1
    line = F.col("line").cast("long") if "line" in messages.columns else F.lit(None).cast("long").alias("line")
    return messages.select("session_id", seq.cast("long").alias("seq"), "role", "content", "thinking", "tool_calls_summary", "timestamp", "injected", line)
