"""How far the sources of a language are from each other in their words, in exact integers.

Terms are runs of ASCII letters and non-ASCII bytes, A-Z as a-z.  A look-up table over the bytes of many texts, one after the other, finds where
terms begin and end; xxhash groups equal slices, and every slice is compared byte by byte with the first of its group.  A task
counts the terms of its texts per (language, source) and deals them out in packed buckets; a bucket of a language is merged
to a matrix of sources by terms in compressed rows, with the terms that enough of the language's documents have.  Every
pair of sources is then summed over the rows' entries by `np.add.reduceat`; what stands in neither row adds a constant.

Memory: a task holds the terms of about `HELD` counts, then one bucket of one language.  How many buckets there are follows
the partitions of the input, so a bucket stays as large as it is however long the table.  What is held for all sources of a
language at once is two numbers per source; the result has a row for every pair of them.

Nulls: a null text, lang or source is empty text, and the empty language and source are as good as others.  A text without a term, or no text,
still counts its group.  Ties of a rank are ordered by the item's UTF-8 bytes.  Repeated rows are documents of their own.  Very
long texts are taken whole.  An empty table gives an empty result.  Further columns, whatever their names, are not read.
Shares are whole numbers of a billion, so pair sums stay below 2**63 while a language has under 2**31 terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import LOT, lots, per_task, workspace, xxh

#: Byte to its lower-case form, 0 where no term has it.
TERM = np.zeros(256, np.uint8)
TERM[0x61:0x7B], TERM[0x80:] = np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
TERM[0x41:0x5B] = TERM[0x61:0x7B]
#: Counts and terms that a task holds before it deals them out.
HELD = 1 << 20
UNIT = 1_000_000_000


def slices(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, begins, ends) of all terms of the texts that stand one after the other in `data`."""
    low = TERM.take(data)
    solid = low != 0
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    return low, np.flatnonzero(first), np.flatnonzero(last) + 1


def grouped(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(group of each slice, the groups' bytes, their hashes): slices of one group are equal byte by byte."""
    raw = low.tobytes()
    h = np.fromiter((xxh(raw[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)), np.uint64, len(s))
    found, first, group = np.unique(h, return_index=True, return_inverse=True)
    size, rep = e - s, first[group]
    same = size == size[rep]
    if same.all():
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = np.array_equal(low[np.repeat(s, size) + nth], low[np.repeat(s[rep], size) + nth])
    if not np.all(same):  # two terms of one hash: told apart by their bytes
        known: dict[bytes, int] = {}
        group = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(s.tolist(), e.tolist(), strict=True)])
        return group, list(known), hashes_of(list(known))
    return group, [raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)], found


def hashes_of(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh, terms), np.uint64, len(terms))


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of `values` for each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


class Counts:
    """Occurrences and documents of each (group, term) that a task has seen since it last dealt them out."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.hash: list[np.ndarray] = []
        self.groups: dict[tuple[int, int], int] = {}
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, low: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray, group_of_doc: np.ndarray) -> None:
        term, found, h = grouped(low, s, e)
        before = len(self.terms)
        ids = np.fromiter((self.terms.setdefault(t, len(self.terms)) for t in found), np.int64, len(found))
        self.hash.append(h[ids >= before])
        pair, n = summed(doc * len(found) + term, np.ones(len(term), np.int64))
        g, t = group_of_doc[pair // len(found)], ids[pair % len(found)]
        self.rows.append(summed(g << 32 | t, n, np.ones(len(n), np.int64)))
        self.n += len(self.rows[-1][0])

    def merge(self) -> None:
        self.rows = [summed(*(np.concatenate(x) for x in zip(*self.rows, strict=True)))]
        self.n = len(self.rows[0][0])

    def dealt(self, buckets: int) -> Iterator[dict[str, list]]:
        """A row for each language and bucket: terms, and (term, group, occurrences, documents) of each count."""
        self.merge()
        key, n, docs = self.rows[0]
        if not len(key):
            return
        g, t = key >> 32, key & 0xFFFFFFFF
        gid, lid = (np.array(x, np.int64) for x in zip(*self.groups, strict=True))
        terms, bucket = list(self.terms), (np.concatenate(self.hash) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((t, bucket[t], lid[g]))
        g, t, n, docs = g[order], t[order], n[order], docs[order]
        b, lang = bucket[t], lid[g]
        edge = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (lang[1:] != lang[:-1])]))
        for low, high in zip(edge.tolist(), [*edge[1:].tolist(), len(g)], strict=True):
            own, at = np.unique(t[low:high], return_inverse=True)
            words = [terms[x] for x in own.tolist()]
            yield {"lid": [int(lang[low])], "bucket": [int(b[low])], **blobs(words), "at": [at.astype(np.uint32).tobytes()], "gid": [gid[g[low:high]].tobytes()], "n": [n[low:high].tobytes()], "docs": [docs[low:high].tobytes()]}


def blobs(words: list[bytes]) -> dict[str, list[bytes]]:
    return {"words": [b"".join(words)], "sizes": [np.array([len(w) for w in words], np.uint32).tobytes()]}


def unblob(words: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64)).tolist()
    return [words[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def count_terms(docs: DataFrame, buckets: int) -> DataFrame:
    """(lid, bucket, words, sizes, at, gid, n, docs) of `docs` (text, gid, lid), packed."""

    def count(batches):
        held = Counts()
        for batch in batches:
            keys = list(zip(batch.column("gid").to_pylist(), batch.column("lid").to_pylist(), strict=True))
            group = np.array([held.groups.setdefault(k, len(held.groups)) for k in keys], np.int64)
            for first, end, data, starts in lots(batch, most=LOT):
                low, s, e = slices(data, starts)
                if len(s):
                    held.add(low, s, e, np.searchsorted(starts, s, "right") - 1, group[first:end])
                if held.n >= HELD:
                    held.merge()
                if held.n >= HELD // 2 or len(held.terms) >= HELD // 2:
                    yield from held.dealt(buckets)
                    held = Counts()
                    group = np.array([held.groups.setdefault(k, len(held.groups)) for k in keys], np.int64)
        if held.rows:
            yield from held.dealt(buckets)

    return per_task(docs, "lid long, bucket int, words binary, sizes binary, at binary, gid binary, n binary, docs binary", count)


SHARD = "lid long, bucket int, v long, words binary, sizes binary, gids array<long>, sums array<long>, ends binary, cols binary, counts binary, whole binary"


def merge_shards(parts: DataFrame, least: int) -> DataFrame:
    """A bucket of a language as a matrix: a row per source (`gids`, its sum, where it ends), a column per term that `least` of
    the language's documents have, in the order of the terms' bytes."""

    def merge(group: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        got = []
        for r in group.to_pylist():
            ids = np.fromiter((known.setdefault(t, len(known)) for t in unblob(r["words"], r["sizes"])), np.int64)
            got.append((ids[np.frombuffer(r["at"], np.uint32)], *(np.frombuffer(r[c], np.int64) for c in ("gid", "n", "docs"))))
        t, gid, n, docs = (np.concatenate(x) for x in zip(*got, strict=True))
        keep = np.bincount(t, docs, len(known)) >= least
        terms = sorted(w for w, k in known.items() if keep[k])
        place = np.full(len(known), -1)
        place[[known[w] for w in terms]] = np.arange(len(terms))
        held = keep[t]
        gids, row = np.unique(gid[held], return_inverse=True)
        key, counts = summed(row * max(1, len(terms)) + place[t[held]], n[held])
        row, cols = key // max(1, len(terms)), key % max(1, len(terms))
        ends = np.searchsorted(row, np.arange(len(gids)), "right")
        whole = summed(cols, counts)[1]
        sums = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], ends])])
        out = {"lid": group.column("lid")[0].as_py(), "bucket": group.column("bucket")[0].as_py(), "v": len(terms), **{k: x[0] for k, x in blobs(terms).items()}, "gids": gids.tolist(), "sums": sums.tolist(), "ends": ends.astype(np.int64).tobytes(), "cols": cols.tobytes(), "counts": counts.tobytes(), "whole": whole.tobytes()}
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4)
        return pa.table([pa.array([x], type=k) for x, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return parts.groupBy("lid", "bucket").applyInArrow(merge, SHARD)


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exact while total is under 2**53: the factor is a thousand, three times."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count + 1
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    d = p - q
    return d * d // q


def by_row(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of each row's entries; a row may have none."""
    out, some = np.zeros(len(begins), np.int64), ends > begins
    if some.any():
        out[some] = np.add.reduceat(values, begins[some])
    return out


def compare(shard: dict, gids: np.ndarray, totals: np.ndarray, v: int, most: int) -> Iterator[tuple[int, np.ndarray, list[tuple[bytes, int]]]]:
    """For each source (by its place in `gids`) its sums against all sources over the shard's terms, and its `most` terms that
    stand out most from the language."""
    wide, own = len(gids), np.argsort(gids)
    row = own[np.searchsorted(gids[own], np.array(shard["gids"], np.int64))] if shard["gids"] else np.empty(0, np.int64)
    stop = np.frombuffer(shard["ends"], np.int64)
    start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    cols, counts, whole = (np.frombuffer(shard[c], np.int64) for c in ("cols", "counts", "whole"))
    terms, width = unblob(shard["words"], shard["sizes"]), shard["v"]
    at = np.repeat(row, stop - start)
    p, none = share(counts, totals[at] + v), share(np.zeros(wide, np.int64), totals + v)
    begins, ends = np.zeros(wide, np.int64), np.zeros(wide, np.int64)
    begins[row], ends[row] = start, stop
    # the rows in the order of their entries, for reduceat
    filled = ends - begins
    lang = share(whole, int(totals.sum()) + v)
    for s in range(wide):
        mine = slice(int(begins[s]), int(ends[s]))
        dense, inside = np.full(width, none[s]), np.zeros(width, bool)
        dense[cols[mine]], inside[cols[mine]] = p[mine], True
        both = inside[cols].astype(np.int64)
        seen = apart(dense[cols], p) - both * apart(dense[cols], none[at])
        value = np.zeros(wide, np.int64)
        value[row], shared = by_row(seen, start, stop), np.zeros(wide, np.int64)
        shared[row] = by_row(both, start, stop)
        kinds, n = np.unique(p[mine], return_counts=True)
        for low in range(0, len(kinds), 256):
            value += (apart(kinds[low : low + 256, None], none[None, :]) * n[low : low + 256, None]).sum(axis=0)
        value += (width - filled[s] - filled + shared) * apart(none[s], none)
        q = lang[cols[mine]]
        over = np.flatnonzero(p[mine] > q)
        f = apart(p[mine][over], q[over])
        order = np.argsort(-f, kind="stable")[:most]
        yield s, value, [(terms[c], x) for c, x in zip(cols[mine][over[order]].tolist(), f[order].tolist(), strict=True)]


def diverge(shards: DataFrame, most: int) -> DataFrame:
    """(lid, s, o, item, value) of shards joined with their language's `sources` (gid, n in order) and `size`: partial sums of pairs of
    sources, and terms that stand out."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                gids, totals = (np.array(r[c], np.int64) for c in ("all_gids", "all_sums"))
                if r["v"] is None:
                    r |= {"v": 0, "words": b"", "sizes": b"", "gids": [], "ends": b"", "cols": b"", "counts": b"", "whole": b""}
                for s, value, terms in compare(r, gids, totals, r["size"], most):
                    others = np.flatnonzero(np.arange(len(gids)) != s)
                    n = len(others) + len(terms)
                    items = pa.array([None] * len(others) + [t.decode() for t, _ in terms], pa.string())
                    o = np.concatenate([others, np.full(len(terms), -1)])
                    if n:
                        yield {"lid": np.full(n, r["lid"]), "s": np.full(n, s, np.int32), "o": o.astype(np.int32), "item": items, "value": np.concatenate([value[others], np.array([f for _, f in terms], np.int64)])}

    return per_task(shards, "lid long, s int, o int, item string, value long", run)


def _numbered(docs: DataFrame) -> tuple[Column, Column]:
    """Hashes of the group (lang, source) and of the language that no two groups share."""
    groups, seed = docs.select("lang", "source").distinct(), 0
    while True:
        gid, lid = F.xxhash64(F.lit(seed), "lang", "source"), F.xxhash64(F.lit(seed), "lang")
        r = groups.agg(F.count("*").alias("groups"), F.count_distinct(gid).alias("gids"), F.count_distinct("lang").alias("langs"), F.count_distinct(lid).alias("lids")).first()
        if r["groups"] == r["gids"] and r["langs"] == r["lids"]:
            return gid, lid
        seed += 1


def divergences(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of `docs` (text, lang, source).

    `pair`: how far each other source of the language is from the source, over the terms that `least` documents of the language have.
    `term`: the `most` terms of the source that stand out most from its language."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    spark, buckets = docs.sparkSession, max(16, 2 * docs.rdd.getNumPartitions())
    gid, lid = _numbered(docs)
    with workspace(spark) as keep:
        shards = keep(merge_shards(count_terms(docs.select("text", gid.alias("gid"), lid.alias("lid")), buckets), least))
        sums = shards.select(F.explode(F.arrays_zip("gids", "sums")).alias("x")).groupBy(F.col("x.gids").alias("gid")).agg(F.sum("x.sums").alias("n"))
        groups = docs.select("lang", "source", gid.alias("gid"), lid.alias("lid")).distinct().join(sums, "gid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        langs = groups.groupBy("lid", "lang").agg(F.sort_array(F.collect_list(F.struct("source", "gid", "n"))).alias("sources"))
        sizes = shards.groupBy("lid").agg(F.sum("v").alias("size"))
        langs = keep(langs.join(sizes, "lid", "left").withColumn("size", F.coalesce("size", F.lit(0))), lasting=True)
        each = langs.select("lid", "size", F.col("sources.gid").alias("all_gids"), F.col("sources.n").alias("all_sums"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
        ready = each.join(shards, ["lid", "bucket"], "left").filter("v is not null or bucket = 0")
        found = keep(diverge(ready, most), lasting=True)
    names = langs.select("lid", "lang", F.posexplode("sources").alias("s", "x")).select("lid", "lang", "s", F.col("x.source").alias("source"))
    others = names.select("lid", F.col("s").alias("o"), F.col("source").alias("item"))
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))
    pairs = found.filter("o >= 0").groupBy("lid", "s", "o").agg(F.sum("value").alias("value")).join(others, ["lid", "o"])
    pairs = pairs.withColumn("rank", order("lid", "s")).select("lid", "s", F.lit("pair").alias("part"), "item", "value", "rank")
    terms = found.filter("o < 0").withColumn("rank", order("lid", "s")).filter(F.col("rank") <= most)
    both = pairs.unionByName(terms.select("lid", "s", F.lit("term").alias("part"), "item", "value", "rank"))
    return both.join(names, ["lid", "s"]).select("lang", "source", "part", "item", "value", "rank")
