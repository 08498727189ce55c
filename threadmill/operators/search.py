"""Full-text search over messages: queries, per-session relevance, ranked hits."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.functions.text import fragment, query_tokens

K1, B, HITS = 1.2, 0.75, 10
HIT = "session_id string, seq long, timestamp string, role string, score double, fragment string, in_thinking boolean, hit_rank int"


#: A clause of a query: whether it must, should or must not hold, and a run of terms or a group of clauses.
Clause = tuple[str, "list[str] | list[Clause]"]
_TOKEN = re.compile(r'([+-]?)(?:(\()|"([^"]*)"|([^\s()"]+))|(\))')


def parse_query(query: str) -> list[Clause]:
    """The clauses of a query: `must` (+ or AND), `not` (- or NOT), else `should`; a quoted phrase holds several terms, parentheses
    a group.  AND binds closer than OR and than clauses that stand side by side.  An unbalanced quote or parenthesis and an operator
    without its clause raise."""
    if query.count('"') % 2:
        raise ValueError("unbalanced quote in search query")
    found, at = _TOKEN.findall(query), 0

    def group(depth: int) -> list[Clause]:
        nonlocal at
        runs: list[list[tuple[str, object]]] = []
        joins, sign = "", ""
        while at < len(found):
            mark, opened, phrase, word, closed = found[at]
            at += 1
            if closed:
                if not depth:
                    raise ValueError("unbalanced parenthesis in search query")
                depth = -1
                break
            if word in ("AND", "OR", "NOT") and not mark:
                if word == "NOT":
                    sign = "not"
                elif joins or sign or not runs:
                    raise ValueError(f"{word} joins nothing in search query")
                else:
                    joins = word
                continue
            node = group(1) if opened else [t for t in re.split(r"[\W_]+", (phrase or word).lower()) if t]
            if node:
                clause = ({"+": "must", "-": "not"}.get(mark, sign), node)
                if joins == "AND" and runs:
                    runs[-1].append(clause)
                else:
                    runs.append([clause])
            joins = sign = ""
        if depth > 0:
            raise ValueError("unbalanced parenthesis in search query")
        if joins or sign:
            raise ValueError("an operator joins nothing in search query")
        return [(r[0][0] or "should", r[0][1]) if len(r) == 1 else ("should", [(m or "must", n) for m, n in r]) for r in runs]

    tree = group(0)
    if not any(m != "not" for m, _ in tree):
        raise ValueError("empty search query")
    return tree


def terms_of(clauses: list[Clause], wanted: bool = False) -> set[str]:
    """All terms, or those alone that no `not` takes away."""
    out: set[str] = set()
    for mode, node in clauses:
        if not (wanted and mode == "not"):
            out |= set(node) if isinstance(node[0], str) else terms_of(node, wanted)
    return out


def predicate(clauses: list[Clause], held: Callable[[list[str]], Column]) -> Column:
    """Whether a message matches: every `must`, no `not`, and without a `must` one of the others.  `held` says whether a run
    of terms stands in the message."""
    met = [(m, held(n) if isinstance(n[0], str) else predicate(n, held)) for m, n in clauses]
    of = lambda mode: [c for m, c in met if m == mode]
    keep = reduce(and_, of("must")) if of("must") else reduce(or_, of("should"), F.lit(False))
    return reduce(lambda a, b: a & ~b, of("not"), keep)


def _times(tokens: str, word: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == word))


def bm25(docs: DataFrame, terms: list[str], key: str = "session_id", doc: str = "seq", fields: tuple[str, ...] = ("content", "thinking")) -> DataFrame:
    """(key, doc, score) of documents with a term; document counts, lengths and frequencies are those of the session.

    Only the query's terms are counted and shuffled; whole texts stay where they are."""
    tokens = query_tokens(F.concat_ws(" ", *fields))
    seen = docs.select(key, doc, tokens.alias("t")).select(key, doc, F.size("t").alias("len"), *(_times("t", w).alias(f"tf{i}") for i, w in enumerate(terms)))
    stats = seen.groupBy(key).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    met = seen.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).join(stats, key)
    part = bm25_sum([(F.col(f"tf{i}"), F.col(f"df{i}")) for i in range(len(terms))], F.col("n_docs"), F.col("len"), F.col("avg_len"))
    return met.select(key, doc, part.alias("score"))


def bm25_sum(counts: list[tuple[Column, Column]], n_docs: Column, size: Column, avg: Column) -> Column:
    """The score of a message whose terms have the given (tf, df)."""
    part = [F.log(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avg)) for tf, df in counts]
    return sum(part[1:], part[0])


def search(messages: DataFrame, query: str, hits: int = HITS) -> DataFrame:
    """Each session's best `hits` messages for a query: score, fragment, in_thinking; best first.  An empty query raises."""
    clauses = parse_query(query)
    text = F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("thinking", F.lit("")))
    padded = F.concat(F.lit(" "), F.array_join(query_tokens(text), " "), F.lit(" "))
    held = lambda terms: F.contains(padded, F.lit(f" {' '.join(terms)} "))
    docs = messages.filter((F.coalesce("content", F.lit("")) != "") | (F.coalesce("thinking", F.lit("")) != ""))
    scored = bm25(docs, sorted(terms_of(clauses, wanted=True)))
    best = W.partitionBy("session_id").orderBy(F.desc("score"), "seq")
    top = docs.filter(predicate(clauses, held)).join(scored, ["session_id", "seq"]).withColumn("hit_rank", F.row_number().over(best)).filter(F.col("hit_rank") <= hits)
    return shown(top, query)


def shown(top: DataFrame, query: str) -> DataFrame:
    """Ranked messages (with score and hit_rank) as hits, best first."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    tokens = query_tokens(F.lit(query))
    in_content, in_thinking = F.exists(tokens, lambda t: F.contains(low("content"), t)), F.exists(tokens, lambda t: F.contains(low("thinking"), t))
    thinking = ~in_content & in_thinking
    return top.select("session_id", "seq", "timestamp", "role", "score", fragment(F.when(thinking, F.col("thinking")).otherwise(F.col("content")), F.lit(query)).alias("fragment"), thinking.alias("in_thinking"), "hit_rank").orderBy(F.desc("score"), "session_id", "hit_rank")


def outcome(found: DataFrame, searched: DataFrame) -> DataFrame:
    """sessions_searched and sessions_with_hits."""
    return searched.agg(F.count_distinct("session_id").alias("sessions_searched")).join(F.broadcast(found.agg(F.count_distinct("session_id").alias("sessions_with_hits"))))
