"""Every query of the library by name, with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.functions import redact, text
from threadmill.operators import budget, dedupe, entries, histogram, index, listing, maintain, profile, qa, search, slicing, summary, todos
from threadmill.plans import reports
from threadmill.sources.scratch import shared_folder
from threadmill.sources.tables import conversation_messages as messages
from threadmill.sources.tables import table
from threadmill.streaming import batches

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
CUTOFF = "2024-01-20 00:00:00"


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from threadmill.plans import stores  # noqa: F401  its queries register here too

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from threadmill.plans import stores  # noqa: F401

    return dict(_ORACLES)


def _marker():
    return F.col("role") == "system"


def _ranked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sessions of a user: session_id, seq (1-based place in time), and the events' columns."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("session_id", F.col("user_id")).withColumn("seq", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"


@_query("""
WITH c AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS line_count, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS file_size, count(*) FILTER (role = 'user') AS user_count,
  count(*) FILTER (role = 'assistant') AS assistant_count, count(*) FILTER (role = 'tool') AS tool_count, bool_or(role = 'system') AS has_compaction,
  count(*) FILTER (turn >= coalesce(last, 0)) AS since_marker, CAST(sum(CASE WHEN turn >= coalesce(last, 0) THEN strlen(coalesce(text, '')) // 4 ELSE 0 END) AS BIGINT) AS tokens_since
FROM c GROUP BY conv_id
""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing counts of every session, with rows and estimated tokens since its last marker."""
    m = messages(spark, sf_dir)
    since = slicing.since_last_marker(m, _marker()).groupBy("session_id").agg(F.count("*").alias("since_marker"), F.sum(text.estimate_tokens("content")).alias("tokens_since"))
    return listing.message_counts(m, _marker()).join(since, "session_id")


@_query("""
SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS line_count, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS file_size, count(*) FILTER (role = 'user') AS user_count,
  count(*) FILTER (role = 'assistant') AS assistant_count, count(*) FILTER (role = 'tool') AS tool_count, bool_or(role = 'system') AS has_compaction
FROM conversations GROUP BY conv_id
""")
def listing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.message_counts(messages(spark, sf_dir), _marker())


@_query(f"""
WITH s AS (SELECT user_id, max(ts) AS updated FROM events GROUP BY user_id), w AS (SELECT * FROM s WHERE updated >= TIMESTAMP '{CUTOFF}' ORDER BY updated DESC, user_id LIMIT 200)
SELECT w.user_id AS session_id, w.updated, count(*) AS parts, (SELECT count(*) FROM s WHERE updated >= TIMESTAMP '{CUTOFF}') AS window_count
FROM w JOIN events e ON e.user_id = w.user_id GROUP BY w.user_id, w.updated
""")
def scoped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 most recent sessions of a window with counts of their rows alone, and the window's size."""
    e = table(spark, sf_dir, "events").withColumn("session_id", F.col("user_id"))
    sessions = e.groupBy("session_id").agg(F.max("ts").alias("updated"))
    window, total = listing.window_sessions(sessions, "updated", F.lit(CUTOFF).cast("timestamp"))
    return window.join(listing.scoped_counts(window, e), "session_id").join(F.broadcast(total))


@_query(f"""
WITH {_RANKED}, m AS (SELECT *, max(CASE WHEN event_type = 'error' THEN seq END) OVER (PARTITION BY user_id) AS last FROM ranked)
SELECT user_id AS session_id, seq, event_id, event_type FROM m WHERE seq >= coalesce(last, 0)
""")
def slice_last_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.since_last_marker(_ranked_events(spark, sf_dir), F.col("event_type") == "error").select("session_id", "seq", "event_id", "event_type")


@_query("SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, left(text, 80) AS summary FROM conversations WHERE role = 'user'")
def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.user_messages(messages(spark, sf_dir)).select("session_id", "seq", text.first_chars("content").alias("summary"))


@_query("""
SELECT session_id, seq, role FROM (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS t FROM conversations) WHERE n > t - 3
""")
def page_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.page(messages(spark, sf_dir), 3).select("session_id", "seq", "role")


@_query("""
SELECT session_id, seq, role FROM (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n > 1 AND n <= 3
""")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.page(messages(spark, sf_dir), 2, offset=1).select("session_id", "seq", "role")


@_query(f"""
WITH {_RANKED} SELECT user_id AS session_id, seq AS line_number, event_type, seq - lag(seq, 1, 0) OVER (PARTITION BY user_id ORDER BY seq) AS gap_lines FROM ranked WHERE event_type IN ('purchase', 'error')
""")
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ranked_events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "error"))
    return profile.gaps(e.select("session_id", F.col("seq").alias("line_number"), F.lit(0).alias("sub"), "event_type")).drop("sub")


@_query("SELECT CAST(conv_id AS VARCHAR) AS session_id, role, count(*) AS n FROM conversations GROUP BY ALL")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.role_counts(messages(spark, sf_dir))


@_query(f"WITH {_RANKED} SELECT user_id AS session_id, arg_min(event_type, seq) AS first_ts, arg_max(event_type, seq) AS last_ts FROM ranked GROUP BY user_id")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.first_last(_ranked_events(spark, sf_dir), "event_type")


@_query("""
WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role, first_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reply FROM conversations)
SELECT session_id, seq, md5(reply) AS reply FROM r WHERE role = 'user'
""")
def next_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.withColumn("reply", qa.next_reply(m, "assistant")).filter("role = 'user'").select("session_id", "seq", F.md5("reply").alias("reply"))


@_query("""
WITH k AS (SELECT n_chars, md5(text) AS hash, doc_id FROM documents), b AS (SELECT n_chars, hash, min(doc_id) AS doc_id, list_sort(list(DISTINCT doc_id)) AS ids FROM k GROUP BY ALL)
SELECT doc_id, hash, array_to_string([CAST(x AS VARCHAR) FOR x IN ids IF x <> doc_id], ',') AS aliases FROM b
""")
def alias_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of documents: the smallest id and its aliases."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5("text").alias("hash")).withColumn("d", F.col("doc_id"))
    out = dedupe.aliases(d, ["n_chars", "hash"], "d", "doc_id")
    return out.select("doc_id", "hash", F.array_join(F.col("aliases").cast("array<string>"), ",").alias("aliases"))


@_query(r"""
WITH f AS (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS line FROM documents)
SELECT s.doc_id, md5(s.line) AS line FROM f s WHERE NOT EXISTS (SELECT 1 FROM f l WHERE l.doc_id < s.doc_id AND (l.line = s.line OR (strlen(l.line) >= 32 AND starts_with(s.line, l.line)) OR (strlen(s.line) >= 32 AND starts_with(l.line, s.line))))
""")
def same_turn_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents that no document before says: equal, or one a long prefix of the other.  Lines meet by their
    first 32 bytes, which both conditions imply, so this is an equi-join and not a nested loop; each line meets others once."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.trim(F.substring_index("text", "\n", 1)).alias("line")).withColumn("head", F.substring(F.col("line").cast("binary"), 1, 32))
    said = d.groupBy(F.col("line").alias("said"), "head").agg(F.min("doc_id").alias("first"))
    return d.join(said, (d["head"] == said["head"]) & (F.col("first") < F.col("doc_id")) & text.same_turn("line", "said"), "left_anti").select("doc_id", F.md5("line").alias("line"))


_HISTOGRAM = """
WITH t AS ({source}), l AS (SELECT k, CASE WHEN ends_with(x, chr(10)) THEN string_split(x, chr(10))[:-2] ELSE string_split(x, chr(10)) END AS ls FROM t WHERE x IS NOT NULL),
u AS (SELECT k, len(ls) AS n, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l)
SELECT k AS {key}, CAST(CASE WHEN n <= 10 THEN i ELSE least(10, (i - 1) // (n // 10) + 1) END AS INTEGER) AS bucket, count(*) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM u GROUP BY ALL
"""


@_query(_HISTOGRAM.format(source="SELECT doc_id AS k, text AS x FROM documents", key="doc_id"))
def line_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.line_histogram(table(spark, sf_dir, "documents"), "doc_id", "text")


@_query(_HISTOGRAM.format(source="SELECT page_id AS k, html AS x FROM pages", key="page_id"))
def page_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.line_histogram(table(spark, sf_dir, "pages"), "page_id", "html")


@_query("""
WITH h AS (SELECT page_id, string_split(html, chr(10)) AS ls FROM pages) SELECT page_id, i AS line_number, ls[i] AS line FROM (SELECT page_id, ls, unnest(range(1, least(3, len(ls)) + 1)) AS i FROM h) WHERE i >= 2
""")
def lines_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.lines_between(table(spark, sf_dir, "pages"), "page_id", "html", 2, 3)


@_query("""
SELECT doc_id, md5(CASE WHEN strlen(text) <= 500 THEN text ELSE left(text, list_max([k FOR k IN range(0, 501) IF strlen(left(text, k)) <= 500])) END) AS cut FROM documents
""")
def utf8_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncate_bytes("text", 500)).alias("cut"))


_RE2_NAME = "|".join(n.replace("_", "[-_]") for n in redact.NAMES)
_RE2 = rf"(?i)(^|[^A-Za-z0-9_.-])((?:[A-Za-z0-9_.-]*[_.-])?(?:{_RE2_NAME})[\"'']?\s*[=:]\s*(?:(?:bearer|basic|digest|token)\s+)?)(\"?)([^\s\"'',;}})\]&#\[=]{{4,}})"


@_query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9])AKIA[A-Z0-9]{{12,}}', '\1[REDACTED:vendor-key]', 'g'), '{_RE2}', '\1\2\3[REDACTED:secret]', 'g')) AS clean FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redact.redact_secrets("text")).alias("clean"))


_BM25 = r"""
WITH t AS (SELECT source, doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE trim(text) <> ''),
d AS (SELECT source, doc_id, len(w) AS len, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'with')) AS b FROM t),
s AS (SELECT source, count(*) AS n, avg(len) AS al, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM d GROUP BY source),
r AS (SELECT d.source, d.doc_id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / al)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / al)) AS score FROM d JOIN s ON d.source = s.source WHERE a > 0 OR b > 0)
"""


@_query(_BM25 + "SELECT source, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM r) WHERE n <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.trim("text") != "")
    scored = search.bm25(d, ["the", "with"], "source", "doc_id", ("text",))
    best = W.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("n", F.row_number().over(best)).filter("n <= 10").select("source", "doc_id", F.round("score", 6).alias("score"))


@_query("""
WITH p AS (SELECT doc_id, text, CASE WHEN strpos(lower(text), 'license') > 0 THEN strpos(lower(text), 'license') ELSE strpos(lower(text), 'the') END AS i FROM documents),
q AS (SELECT doc_id, text, i, strlen(left(lower(text), CAST(i - 1 AS INTEGER))) AS b FROM p WHERE i > 0 AND strlen(lower(text)) = strlen(text) AND strlen(text) = length(text))
SELECT doc_id, md5(substr(text, greatest(b - 50, 0) + 1, least(strlen(text), b + 200) - greatest(b - 50, 0))) AS fragment FROM q
""")
def search_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments around the first hit, over texts in which bytes and characters agree (the SQL counts characters)."""
    d = table(spark, sf_dir, "documents").filter((F.octet_length("text") == F.length("text")) & (F.contains(F.lower("text"), F.lit("license")) | F.contains(F.lower("text"), F.lit("the"))))
    return d.select("doc_id", F.md5(text.fragment("text", F.lit("License the"))).alias("fragment"))


@_query()
def search_fragment_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments around the first hit of all documents that have one, whatever their bytes."""
    d = table(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lit("license")) | F.contains(F.lower("text"), F.lit("the")))
    return d.select("doc_id", F.md5(text.fragment("text", F.lit("License the"))).alias("fragment"))


@_query("""
SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) FILTER (role = 'user') AS user, count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'tool') AS tool, 0::BIGINT AS thinking,
  CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, CAST(sum(strlen(coalesce(text, '')) // 4) AS BIGINT) AS tokens_est FROM conversations GROUP BY conv_id
""")
def slice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.slice_counts(messages(spark, sf_dir))


_TODO = """
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS content, arg_max(CASE WHEN value < 50 THEN 'open' ELSE 'completed' END, event_id) AS status FROM events GROUP BY ALL),
f AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS nth FROM (SELECT DISTINCT user_id, day FROM e)),
i AS (SELECT e.*, nth FROM e JOIN f USING (user_id, day)),
c AS (SELECT i.user_id, i.nth, i.content, CASE WHEN p.content IS NULL THEN 'added' WHEN p.status <> i.status THEN i.status END AS action, i.status FROM i LEFT JOIN i p ON p.user_id = i.user_id AND p.nth = i.nth - 1 AND p.content = i.content),
r AS (SELECT p.user_id, p.nth + 1 AS nth, p.content, 'removed' AS action, NULL AS status FROM i p JOIN f ON f.user_id = p.user_id AND f.nth = p.nth + 1 WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.user_id = p.user_id AND i.nth = p.nth + 1 AND i.content = p.content)),
x AS (SELECT * FROM c WHERE action IS NOT NULL UNION ALL SELECT * FROM r)
"""


def _flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot per user and day: event types as items, done or open by their last value that day."""
    e = table(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "status": F.when(F.col("value") < 50, "open").otherwise("completed")})
    last = e.groupBy("user_id", "day", "event_type").agg(F.max_by("status", "event_id").alias("status"))
    item = F.struct(F.col("event_type").alias("content"), "status", F.lit(None).cast("string").alias("priority"))
    return last.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(item)).alias("todos")).select(F.col("user_id").alias("session_id"), F.col("day").alias("flush"), F.col("day").cast("string").alias("timestamp"), "todos")


@_query(_TODO + "SELECT user_id AS session_id, CAST(nth AS INTEGER) AS nth, content AS todo, action, status FROM x")
def todo_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return todos.todo_events(_flushes(spark, sf_dir)).select("session_id", "nth", "todo", "action", "status")


@_query(_TODO + """, o AS (SELECT user_id, count(*) FILTER (action = 'added') AS added, count(*) FILTER (action IN ('completed', 'cancelled', 'removed')) AS closed FROM x GROUP BY user_id),
b AS (SELECT user_id, count(*) AS base FROM i WHERE nth = 1 GROUP BY user_id)
SELECT o.user_id AS session_id, greatest(0, added - coalesce(base, 0)) AS opened, closed, greatest(0, added - coalesce(base, 0)) > closed AS churning FROM o LEFT JOIN b ON o.user_id = b.user_id""")
def todo_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flushes(spark, sf_dir)
    first = f.groupBy("session_id").agg(F.min_by(F.size("todos"), "flush").alias("baseline"))
    return todos.churn(todos.todo_events(f), first)


@_query("""
SELECT session_id, seq FROM (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, sum(strlen(text) + 1) OVER w AS used, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE used <= 900 OR n = 1
""")
def fit_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("len", F.octet_length("content"))
    return budget.fit_prefix(m, 900, "len").select("session_id", "seq")


@_query("""
WITH c AS (SELECT conv_id, turn, text, strlen(text) + CASE WHEN row_number() OVER w = 1 THEN 0 ELSE 1 END AS cost FROM conversations WHERE coalesce(text, '') <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
u AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM c)
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, md5(text) AS block FROM u WHERE used <= 20000 - 256
""")
def tail_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = budget.tail_budget(messages(spark, sf_dir), 20_000, "content")
    return kept.select("session_id", "seq", F.md5("content").alias("block"))


@_query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, strlen(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
g AS (SELECT conv_id, turn, n, 1 + len + 1 <= 1200 AS ok, CASE WHEN 1 + len + 1 <= 1200 THEN 1 + len ELSE 1 END AS used, CASE WHEN 1 + len + 1 <= 1200 THEN 1 ELSE 0 END AS k FROM c WHERE n = 1
UNION ALL SELECT c.conv_id, c.turn, c.n, g.used + (CASE WHEN g.k > 0 THEN 1 ELSE 0 END) + c.len + 1 <= 1200, CASE WHEN g.used + (CASE WHEN g.k > 0 THEN 1 ELSE 0 END) + c.len + 1 <= 1200 THEN g.used + (CASE WHEN g.k > 0 THEN 1 ELSE 0 END) + c.len ELSE g.used END,
  CASE WHEN g.used + (CASE WHEN g.k > 0 THEN 1 ELSE 0 END) + c.len + 1 <= 1200 THEN g.k + 1 ELSE g.k END FROM g JOIN c ON c.conv_id = g.conv_id AND c.n = g.n + 1)
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, ok AS admitted FROM g
""")
def greedy_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("len", F.octet_length("content"))
    return budget.greedy_admission(m, 1200, "len")


@_query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5")
def prune_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.prune(table(spark, sf_dir, "events"), "user_id", "event_id", 5)[0].select("user_id", "event_id")


@_query("SELECT l.doc_id, 'label' AS kind FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) UNION ALL SELECT d.doc_id, 'document' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    a = maintain.orphans(t("labels"), "doc_id", t("documents"), "doc_id").select("doc_id", F.lit("label").alias("kind"))
    return a.unionByName(maintain.orphans(t("documents"), "doc_id", t("labels"), "doc_id").select("doc_id", F.lit("document").alias("kind")))


_TABLES = ("orders", "customer", "lineitem", "labels", "documents", "conversations", "events")


@_query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.reconcile({t: table(spark, sf_dir, t) for t in _TABLES})


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@_query("""
SELECT CAST(conv_id AS VARCHAR) AS session_id, 0 AS section, turn AS seq, md5(text) AS body FROM conversations WHERE role = 'user' AND text <> ''
UNION ALL SELECT CAST(conv_id AS VARCHAR), 1, turn, md5(text) FROM conversations WHERE role = 'assistant' AND trim(text) <> '' UNION ALL SELECT CAST(conv_id AS VARCHAR), 2, turn, md5(text) FROM conversations WHERE role = 'system'
""")
def said_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadmill.plans.reports import said_did as report

    out = report(messages(spark, sf_dir), _marker())
    return out.select("session_id", "section", "seq", F.md5("body").alias("body"))


@_query(r"""
WITH c AS (SELECT conv_id, turn, role = 'system' AS mk, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS nl FROM conversations),
s AS (SELECT *, count(*) OVER w AS messages_since, CAST(coalesce(sum(nl) OVER w, 0) AS BIGINT) AS lines_since FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, greatest(count(*) OVER (PARTITION BY conv_id) - 3, 0) AS held_back FROM s WHERE mk)
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, messages_since, lines_since, held_back FROM r WHERE n <= 3
""")
def compaction_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.compaction_footer(messages(spark, sf_dir), _marker())


@_query("""
SELECT o_custkey AS session_id, count(*) AS n_children, array_to_string(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey)[1:10], ',') AS child_ids FROM orders GROUP BY o_custkey
""")
def children_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = listing.children(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate", keep=10)
    return kids.select(F.col("o_custkey").alias("session_id"), "n_children", F.array_join(F.col("child_ids").cast("array<string>"), ",").alias("child_ids"))


@_query("""
WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, 'c' || lpad(CAST(conv_id AS VARCHAR), 8, '0') AS end_time, CAST(sum(strlen(text)) AS BIGINT) * 900 AS size, count(*) AS n FROM conversations GROUP BY conv_id),
t AS (SELECT *, row_number() OVER (ORDER BY end_time DESC, session_id) AS ord FROM s)
SELECT CAST(ord AS INTEGER) AS ord, '| ' || session_id || ' | ' || end_time || ' | ' || CASE WHEN size >= 1000000 THEN printf('%.1fMB', size / 1e6) ELSE CAST(size // 1000 AS VARCHAR) || 'KB' END || ' | ' || CAST(n AS VARCHAR) || ' | |' AS line FROM t WHERE ord <= 200
""")
def rollouts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = listing.message_counts(messages(spark, sf_dir), _marker())
    s = m.select("session_id", F.concat(F.lit("c"), F.lpad("session_id", 8, "0")).alias("end_time"), (F.col("file_size") * 900).alias("file_size"), "line_count")
    return listing.rollouts_table(s)


@_query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.sessions(table(spark, sf_dir, "events"))


@_query("""
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS idx, entry_type FROM (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role AS entry_type FROM conversations WHERE role IN ('user', 'assistant', 'tool'))
""")
def typed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.typed_entries(messages(spark, sf_dir)).select("session_id", "idx", "entry_type")


@_query("""
WITH b AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, 0 AS part, role AS entry_type FROM conversations WHERE role IN ('user', 'assistant', 'tool') UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, 2, 'compaction' FROM conversations WHERE role = 'system')
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY part, turn) - 1 AS idx, entry_type FROM b
""")
def derived_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed entries with the markers behind them as `compaction` entries, densely numbered."""
    m = messages(spark, sf_dir)
    marks = m.filter(_marker()).select("session_id", F.col("seq").alias("n"), "timestamp", F.to_json(F.struct("content")).alias("record"))
    return entries.with_derived(entries.typed_entries(m), {"compaction": marks}).select("session_id", "idx", "entry_type")


@_query("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id FROM conversations), x AS (SELECT * FROM t WHERE id > 2)
SELECT CAST(c.conv_id AS VARCHAR) AS session_id, 1::BIGINT AS blocks, 2::BIGINT AS through_id, 3::BIGINT AS expected_from_id, coalesce(u, 0) AS tail_user, coalesce(a, 0) AS tail_assistant, coalesce(k, 0)::BIGINT AS tail_tokens_est
FROM (SELECT DISTINCT conv_id FROM t) c LEFT JOIN (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, CAST(sum(strlen(text) // 4) AS BIGINT) AS k FROM x GROUP BY conv_id) x ON x.conv_id = c.conv_id
""")
def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a ledger whose one block per session holds its first two messages."""
    m = messages(spark, sf_dir)
    block = m.select("session_id").distinct().select("session_id", F.lit(1).cast("long").alias("from_id"), F.lit(2).cast("long").alias("to_id"))
    return summary.status(block, m).select("session_id", "blocks", "through_id", "expected_from_id", "tail_user", "tail_assistant", "tail_tokens_est")


@_query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, left(strftime(ts, '%Y%m%d%H%M%S'), 14)::BIGINT AS digits FROM events WHERE epoch_us(ts) // 1000 % 1000 = 0 UNION ALL SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z', strftime(ts, '%Y%m%d%H%M%S')::BIGINT FROM events WHERE epoch_us(ts) // 1000 % 1000 <> 0")
def iso_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("iso", text.iso_from_millis(F.unix_millis(F.col("ts").cast("timestamp"))))
    return e.select("event_id", "iso", text.stamp_digits("iso").alias("digits"))


@_query("""
WITH q AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos, text FROM conversations)
SELECT u.session_id, u.pos::INTEGER AS pos, md5(u.text) AS question, md5(a.text) AS answer FROM q u JOIN q a ON a.session_id = u.session_id AND a.pos = u.pos AND a.role = 'assistant' WHERE u.role = 'user'
""")
def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as a call's questions and assistant turns as its answers: none names its question, so places decide."""
    m = messages(spark, sf_dir)
    listed = lambda role, item: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("seq", item)))), lambda x: x["x"])
    q = F.struct(F.col("content").alias("question"), F.lit(None).cast("string").alias("header"), F.array().cast("array<struct<label:string,description:string>>").alias("options")).alias("x")
    r = F.struct(F.lit(None).cast("string").alias("question"), F.col("content").alias("answer")).alias("x")
    calls = m.groupBy("session_id").agg(listed("user", q).alias("questions"), listed("assistant", r).alias("records")).filter(F.size("questions") > 0).withColumns({"seq": F.lit(0).cast("long"), "timestamp": F.lit(None).cast("string")})
    return qa.pair_answers(calls).select("session_id", "pos", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@_query("""
WITH RECURSIVE m AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, '{"type":"message","role":' || to_json(role) || ',"content":' || to_json(text) || ',"tool_calls_summary":[],"injected":' || (role = 'system') || ',"truncated":false}' AS j FROM conversations),
t AS (SELECT session_id, -1 AS turn, '{"type":"meta","tool":"extract_messages","session_id":"' || session_id || '","total":' || count(*) || ',"returned":' || count(*) || ',"truncated":0}' AS j FROM m GROUP BY session_id),
c AS (SELECT *, strlen(j) AS len, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n FROM (SELECT * FROM t UNION ALL SELECT * FROM m)),
g AS (SELECT session_id, n, len, j, 1 + len + 1 <= 1500 AS ok, CASE WHEN 1 + len + 1 <= 1500 THEN 1 + len ELSE 1 END AS used, CASE WHEN 1 + len + 1 <= 1500 THEN 1 ELSE 0 END AS k FROM c WHERE n = 1
UNION ALL SELECT c.session_id, c.n, c.len, c.j, g.used + least(g.k, 1) + c.len + 1 <= 1500, CASE WHEN g.used + least(g.k, 1) + c.len + 1 <= 1500 THEN g.used + least(g.k, 1) + c.len ELSE g.used END,
  CASE WHEN g.used + least(g.k, 1) + c.len + 1 <= 1500 THEN g.k + 1 ELSE g.k END FROM g JOIN c ON c.session_id = g.session_id AND c.n = g.n + 1)
SELECT session_id, md5('[' || string_agg(j, ',' ORDER BY n) FILTER (ok) || ']') AS response, CAST(sum(len) FILTER (ok) + count(*) FILTER (ok) + 1 AS INTEGER) AS returned_bytes, CAST(sum(len) + count(*) + 1 AS BIGINT) AS total_bytes,
  count(*) FILTER (ok AND n > 1) AS records_returned, count(*) FILTER (n > 1) AS records_total, bool_or(NOT ok) AS overflow FROM g GROUP BY session_id
""")
def respond_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded responses: the meta record first, then the messages that fit 1,500 bytes, greedily."""
    meta, rows = reports.extract_messages(messages(spark, sf_dir), _marker(), full=True, limit=1000)
    out = reports.respond("extract_messages", meta, rows, 1500)
    return out.select("session_id", F.md5("response").alias("response"), "returned_bytes", "total_bytes", "records_returned", "records_total", "overflow")


@_query()
def bounded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-bounded prompts of all sessions."""
    from threadmill.plans.prompts import bounded_prompt

    return bounded_prompt(messages(spark, sf_dir), 2_000)


_HITS = r"""
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM conversations WHERE coalesce(text, '') <> ''),
d AS (SELECT *, len(w) AS len, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'with')) AS b, ' ' || array_to_string(w, ' ') || ' ' AS p FROM t),
s AS (SELECT session_id, count(*) AS n, avg(len) AS al, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM d GROUP BY session_id),
r AS (SELECT d.*, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / al)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / al)) AS score FROM d JOIN s ON d.session_id = s.session_id),
"""
#: The first token's place in the lower-cased text, in bytes, and the whole characters from 50 bytes before to 200 behind it.
_FRAGMENT = """
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, seq) AS hit_rank FROM m),
f AS (SELECT *, CASE WHEN strpos(lower(text), tok1) > 0 THEN strpos(lower(text), tok1) WHEN strpos(lower(text), tok2) > 0 THEN strpos(lower(text), tok2) ELSE 1 END AS i FROM k WHERE hit_rank <= 10),
g AS (SELECT *, strlen(left(lower(text), CAST(i - 1 AS INTEGER))) AS hit FROM f),
h AS (SELECT *, list_filter(range(0, length(text) + 1), lambda c: strlen(left(text, CAST(c AS INTEGER))) >= greatest(hit - 50, 0))[1] AS c0, list_filter(range(0, length(text) + 1), lambda c: strlen(left(text, CAST(c AS INTEGER))) <= hit + 200)[-1] AS c1 FROM g)
SELECT session_id, seq, role, round(score, 4) AS score, substring(text, CAST(c0 + 1 AS INTEGER), CAST(c1 - c0 AS INTEGER)) AS fragment, false AS in_thinking, CAST(hit_rank AS INTEGER) AS hit_rank FROM h
"""
_AND_NOT = "m AS (SELECT *, 'the' AS tok1, 'with' AS tok2 FROM r WHERE a > 0 AND NOT list_contains(w, 'license'))," + _FRAGMENT


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("session_id", "seq", "role", F.round(F.col("score").cast("double"), 4).alias("score"), "fragment", "in_thinking", "hit_rank")


@_query(_HITS + _AND_NOT)
def search_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's best messages for a query with a required and an unwanted term, from the messages themselves."""
    return _rounded(search.search(messages(spark, sf_dir), "+the with -license"))


@_query(_HITS + _AND_NOT)
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index of all conversations, of which the terms' buckets alone are read."""
    folder = shared_folder(spark, "index")
    index.index_messages(messages(spark, sf_dir), folder)
    return _rounded(index.search_index(spark, folder, "+the with -license"))


@_query(r"""
WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM conversations WHERE coalesce(text, '') <> ''),
d AS (SELECT *, len(w) AS len, ' ' || array_to_string(w, ' ') || ' ' AS p FROM t),
s AS (SELECT session_id, count(*) AS n, avg(len) AS al FROM d GROUP BY session_id),
c AS (SELECT session_id, seq, x.term, len(list_filter(w, lambda y: y = x.term)) AS tf, len FROM d, (SELECT unnest(['the', 'in', 'with', 'of']) AS term) x),
f AS (SELECT session_id, term, count(*) FILTER (tf > 0) AS df FROM c GROUP BY ALL),
r AS (SELECT c.session_id, c.seq, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM c JOIN f ON c.session_id = f.session_id AND c.term = f.term JOIN s ON s.session_id = c.session_id GROUP BY ALL),
m AS (SELECT d.session_id, d.seq FROM d WHERE (list_contains(w, 'the') OR contains(p, ' in the ')) AND (list_contains(w, 'with') OR contains(p, ' of the ')) AND NOT contains(p, ' to the '))
SELECT session_id, seq, round(score, 4) AS score, CAST(k AS INTEGER) AS hit_rank FROM (SELECT r.*, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, seq) AS k FROM r JOIN m USING (session_id, seq)) WHERE k <= 10
""")
def search_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and phrases, from an index: one of two in each of two groups, and a phrase that must not stand."""
    folder = shared_folder(spark, "index")
    index.index_messages(messages(spark, sf_dir), folder)
    found = index.search_index(spark, folder, '(the OR "in the") AND (with OR "of the") AND NOT "to the"')
    return found.select("session_id", "seq", F.round(F.col("score").cast("double"), 4).alias("score"), "hit_rank")


@_query(r"""
WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM conversations WHERE trim(text) <> ''),
d AS (SELECT conv_id, turn, len(w) AS len, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'with')) AS b, list_contains(w, 'license') AS c FROM t),
s AS (SELECT conv_id, count(*) AS n, avg(len) AS al, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM d GROUP BY conv_id),
r AS (SELECT d.conv_id, d.turn, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / al)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / al)) AS score FROM d JOIN s ON d.conv_id = s.conv_id WHERE a > 0 AND NOT c)
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, round(score, 4) AS score, CAST(n AS INTEGER) AS hit_rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS n FROM r) WHERE n <= 10
""")
def search_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and ranks of the same search: a required, a wanted and an unwanted term."""
    return search.search(messages(spark, sf_dir), "+the with -license").select("session_id", "seq", F.round(F.col("score").cast("double"), 4).alias("score"), "hit_rank")


@_query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL
""")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the watermarked stream: counts per hour and type."""
    return batches.hourly(table(spark, sf_dir, "events"))
