"""A full-text index in files that searches read in place of the messages.

A folder holds three Parquet tables.  `postings` has a row per term and message with the term's places, in folders by a hash of
the term and sorted by it, so a query reads the folders of its terms, and of those the row groups that may hold them.  `docs` has the
messages, in folders by a hash of the session.  `commits` has a row per session and run: how many messages and tokens the run
indexed, the source's time, and how many postings each folder got.

A run appends postings and messages under its own name and commits last.  What a session's latest commit names is its index: a run that
fails leaves rows that nobody reads, a rerun replaces whole sessions, and readers never see half of one.  `compact` rewrites the folder
without the rows that no commit names.  Counts in the commit tell a session whose files were lost or damaged from one without hits."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.functions.text import fragment, query_tokens
from threadmill.operators import search

#: Folders of postings and of messages.
BUCKETS, PARTS = 64, 16
COMMITS = "session_id string, run string, built_at timestamp, source_mtime timestamp, doc_count long, tokens long, buckets int, rows map<int,long>"
DOCS = "session_id string, run string, seq long, role string, timestamp string, content string, thinking string, len int, part int"
POSTINGS = "session_id string, run string, seq long, term string, len int, places array<int>, bucket int"


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.col(term).cast("binary")), F.lit(buckets)).cast("int")


def _part(session: str = "session_id") -> Column:
    return F.pmod(F.crc32(F.col(session).cast("binary")), F.lit(PARTS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the folder; empty if there is none yet.  Files that are damaged or gone are passed over: `damaged` names
    whose rows are missing."""
    if not _exists(spark, f"{folder}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(f"{folder}/{name}")


def postings(docs: DataFrame, buckets: int) -> DataFrame:
    """(session_id, run, seq, term, len, places, bucket) of messages with their tokens `t`."""
    flat = docs.select("session_id", "run", "seq", "len", F.posexplode("t").alias("pos", "term"))
    return flat.groupBy("session_id", "run", "seq", "len", "term").agg(F.sort_array(F.collect_list("pos")).alias("places")).withColumn("bucket", _bucket("term", buckets))


def index_messages(messages: DataFrame, folder: str, mtimes: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Index all sessions of `messages`, each as a whole: (session_id, doc_count) of what was committed.  `mtimes` (session_id, mtime)
    says how new the sources are; messages without content and thinking are not indexed, a session of such messages is
    committed with none.  Another number of buckets than the folder's raises."""
    spark, run = messages.sparkSession, uuid.uuid4().hex
    known = _table(spark, folder, "commits", COMMITS).agg(F.max("buckets")).first()[0]
    if known not in (None, buckets):
        raise ValueError(f"the index has {known} buckets")
    both = F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("thinking", F.lit("")))
    docs = messages.filter((F.coalesce("content", F.lit("")) != "") | (F.coalesce("thinking", F.lit("")) != ""))
    docs = docs.select("session_id", F.lit(run).alias("run"), F.col("seq").cast("long").alias("seq"), "role", "timestamp", "content", "thinking", F.size(query_tokens(both)).alias("len"), _part().alias("part"))
    docs.hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(f"{folder}/docs")
    mine = _table(spark, folder, "docs", DOCS).filter(F.col("run") == run)
    made = postings(mine.withColumn("t", query_tokens(both)), buckets)
    made.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "session_id").write.mode("append").partitionBy("bucket").parquet(f"{folder}/postings")
    rows = _table(spark, folder, "postings", POSTINGS).filter(F.col("run") == run).groupBy("session_id", "bucket").agg(F.count("*").alias("n"))
    rows = rows.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("rows"))
    sizes = mine.groupBy("session_id").agg(F.count("*").alias("doc_count"), F.sum("len").cast("long").alias("tokens"))
    out = messages.select("session_id").distinct().join(sizes, "session_id", "left").join(rows, "session_id", "left")
    out = out.join(mtimes.select("session_id", F.col("mtime").cast("timestamp").alias("source_mtime")), "session_id", "left") if mtimes is not None else out.withColumn("source_mtime", F.lit(None).cast("timestamp"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = F.create_map().cast("map<int,long>")
    out.select("session_id", F.lit(run).alias("run"), F.current_timestamp().alias("built_at"), "source_mtime", count("doc_count"), count("tokens"), F.lit(buckets).alias("buckets"), F.coalesce("rows", none).alias("rows")).write.mode("append").parquet(f"{folder}/commits")
    return _table(spark, folder, "commits", COMMITS).filter(F.col("run") == run).select("session_id", "doc_count")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """Each session's latest commit."""
    rows = _table(spark, folder, "commits", COMMITS)
    last = F.max_by(F.struct("run", "built_at", "source_mtime", "doc_count", "tokens", "buckets", "rows"), F.struct("built_at", "run"))
    return rows.groupBy("session_id").agg(last.alias("c")).select("session_id", "c.*")


def stale(spark: SparkSession, folder: str, sessions: DataFrame) -> DataFrame:
    """Of `sessions` (session_id, mtime, backend_kind) those without an index or, if they are files, with one of another second.
    A database says nothing about its time, so what is indexed of it stays until it is indexed again."""
    met = sessions.join(committed(spark, folder).select("session_id", "source_mtime", F.lit(True).alias("indexed")), "session_id", "left")
    other = ~F.date_trunc("second", "mtime").eqNullSafe(F.date_trunc("second", "source_mtime"))
    return met.filter(F.col("indexed").isNull() | ((F.col("backend_kind") == "file") & other)).select("session_id", "backend_kind", F.col("indexed").isNotNull().alias("indexed"))


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """Write what the commits name to the folder `to`: messages, postings, and the commits last."""
    now = committed(spark, folder)
    live = now.select("session_id", "run")
    for name, schema, by in (("docs", DOCS, "part"), ("postings", POSTINGS, "bucket")):
        rows = _table(spark, folder, name, schema).join(live, ["session_id", "run"], "left_semi").hint("rebalance", by)
        (rows.sortWithinPartitions("bucket", "term", "session_id") if by == "bucket" else rows).write.mode("append").partitionBy(by).parquet(f"{to}/{name}")
    now.write.mode("append").parquet(f"{to}/commits")


def _read(spark: SparkSession, folder: str, buckets: list[int], live: DataFrame) -> DataFrame:
    """The live postings of some buckets."""
    return _table(spark, folder, "postings", POSTINGS).filter(F.col("bucket").isin(buckets)).join(live, ["session_id", "run"])


def matches(spark: SparkSession, folder: str, query: str, live: DataFrame) -> DataFrame:
    """(session_id, run, seq, score) of the messages that a query matches, from the postings of its terms alone."""
    tree = search.parse_query(query)
    asked, wanted = sorted(search.terms_of(tree)), sorted(search.terms_of(tree, wanted=True))
    n = live.agg(F.max("buckets")).first()[0] or BUCKETS
    rows = _read(spark, folder, sorted({bucket_of(t, n) for t in asked}), live.select("session_id", "run", "doc_count", "tokens")).filter(F.col("term").isin(asked))
    place = {t: f"p{i}" for i, t in enumerate(asked)}
    docs = rows.groupBy("session_id", "run", "seq", "len", "doc_count", "tokens").agg(*(F.first(F.when(F.col("term") == t, F.col("places")), ignorenulls=True).alias(p) for t, p in place.items()))
    have = rows.groupBy("session_id").agg(*(F.count_if(F.col("term") == t).alias(f"df_{place[t]}") for t in wanted))

    def held(terms: list[str]) -> Column:
        first, *rest = (F.col(place[t]) for t in terms)
        if not rest:
            return first.isNotNull()
        follow = lambda x: F.forall(F.array(*(F.array_contains(p, x + i + 1) for i, p in enumerate(rest))), lambda b: b)
        met = F.exists(first, follow)
        for p in rest:
            met = p.isNotNull() & met
        return F.coalesce(first.isNotNull() & met, F.lit(False))

    scored = search.bm25_sum([(F.coalesce(F.size(place[t]), F.lit(0)), F.col(f"df_{place[t]}")) for t in wanted], F.col("doc_count"), F.col("len"), F.col("tokens") / F.col("doc_count"))
    return docs.filter(search.predicate(tree, held)).join(have, "session_id").select("session_id", "run", "seq", scored.alias("score"))


def search_index(spark: SparkSession, folder: str, query: str, selected: DataFrame | None = None, hits: int = search.HITS) -> DataFrame:
    """The same as `search.search`, from an index; with `selected` (session_id), of these sessions only."""
    live = committed(spark, folder).filter("doc_count > 0")
    live = live if selected is None else live.join(selected.select("session_id").distinct(), "session_id", "left_semi")
    best = W.partitionBy("session_id").orderBy(F.desc("score"), "seq")
    top = matches(spark, folder, query, live).withColumn("hit_rank", F.row_number().over(best)).filter(F.col("hit_rank") <= hits).withColumn("part", _part())
    docs = _table(spark, folder, "docs", DOCS).select("session_id", "run", "seq", "role", "timestamp", "content", "thinking", "part")
    return search.shown(docs.join(top, ["part", "session_id", "run", "seq"]), query)


def damaged(spark: SparkSession, folder: str, selected: DataFrame, query: str) -> DataFrame:
    """(session_id, error) of the selected sessions that a query cannot be answered for: it is no query, or rows that the session's
    commit counts are missing in the folders that the query reads."""
    try:
        tree = search.parse_query(query)
    except ValueError as e:
        return selected.select("session_id", F.lit(f"invalid query {query!r}: {e}").alias("error")).distinct()
    live = committed(spark, folder).join(selected.select("session_id").distinct(), "session_id", "left_semi")
    n = live.agg(F.max("buckets")).first()[0] or BUCKETS
    asked = sorted({bucket_of(t, n) for t in search.terms_of(tree)})
    want = sum((F.coalesce(F.try_element_at("rows", F.lit(b)), F.lit(0)) for b in asked), F.lit(0))
    got = _read(spark, folder, asked, live.select("session_id", "run")).groupBy("session_id").agg(F.count("*").alias("got"))
    docs = _table(spark, folder, "docs", DOCS).select("session_id", "run").join(live.select("session_id", "run"), ["session_id", "run"], "left_semi").groupBy("session_id").agg(F.count("*").alias("docs"))
    met = live.select("session_id", "doc_count", want.alias("want")).join(got, "session_id", "left").join(docs, "session_id", "left")
    short = (F.coalesce("got", F.lit(0)) != F.col("want")) | (F.coalesce("docs", F.lit(0)) != F.col("doc_count"))
    return met.filter(short).select("session_id", F.lit("cannot read the whole index").alias("error"))


def search_report(spark: SparkSession, folder: str, query: str, selected: DataFrame, unmatched: DataFrame, hits: int = search.HITS) -> tuple[DataFrame, DataFrame]:
    """(meta, hits): one row of sessions_searched, sessions_with_hits, not_indexed, unmatched and corrupt, and the hits in order.

    `selected` (session_id) are the sessions that are asked for, `unmatched` (id) the ids that no session has.  An empty query raises."""
    if not query.strip():
        raise ValueError("empty search query")
    bad = damaged(spark, folder, selected, query)
    try:
        found = search_index(spark, folder, query, selected.join(bad, "session_id", "left_anti"), hits)
    except ValueError:
        found = spark.createDataFrame([], search.HIT)
    missing = selected.join(committed(spark, folder), "session_id", "left_anti")
    listed = lambda df, c, name: df.agg(F.sort_array(F.collect_set(c)).alias(name))
    meta = selected.agg(F.count_distinct("session_id").alias("sessions_searched")).join(found.agg(F.count_distinct("session_id").alias("sessions_with_hits")))
    for part in (listed(missing, F.col("session_id"), "not_indexed"), listed(unmatched, F.col("id"), "unmatched"), listed(bad, F.concat_ws(": ", "session_id", "error"), "corrupt")):
        meta = meta.join(part)
    return meta.select(F.lit("meta").alias("type"), F.lit(query).alias("query"), *meta.columns), found
