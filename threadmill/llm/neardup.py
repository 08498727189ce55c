"""MinHash near-dedup with bottom-k sketches from one hash function.

1. A document's sketch is the k smallest hashes of its shingles; documents with the same set (a digest of 128 bits) form a
   class, of which each task passes on one sketch.
2. The inverted list of a retained value holds the documents whose sketch has it.  Two documents at the threshold share at
   least `need` retained values (exactly so for sets that fit in the sketch, else but for a chance, of five standard
   deviations of a draw without putting back), so it is enough to list one under the rarest k - need + 1 of its values.  A
   value that is retained very often is listed together with a second one, so that no list grows with the corpus alone.
3. In each list every member is compared with the earlier ones: sizes, what is left behind the shared value in both orders,
   and a parity bitmap of the sketch leave candidate pairs.  The nearest pass the union-sketch estimate and are verified by
   exact Jaccard on whole texts, and so is each one's first candidate, so that groups of near copies meet in one component at once.
4. Members with more candidates than are kept meet their lists' members of other components once more: the member of the
   smaller component is verified on whole texts against all documents of the larger one, which is dealt into blocks.  So
   no link between components is lost, and no group is expanded into its pairs.

Defined results: null text and text without words have an empty set, link with nothing and are kept; a null doc_id is
not linked, its component is null and it is kept; repeated rows of a doc_id share its result; texts with fewer words
than a shingle are one shingle of all their words; very long texts are read whole; of documents that tie the smallest
doc_id is kept; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import MIX, bytes_of, cut, lots, mark_cells, marked, per_batch, per_task, scramble, sum_cells, windows, word_hashes
from threadmill.llm.graph import components
from threadmill.llm.lists import HELD, Lists, buckets, dealt, gathered, hot_rank, in_lists, listed, rarity

SKETCH, SLACK_SD = 96, 5.0
#: Earlier members of a list that one is compared with, and candidates that are kept of them.
HUBS, KEPT = 4096, 2
#: Cells in which retained values are counted, and counts above which one is listed with a second one.
CELLS, HOT = 1 << 18, 1 << 16
#: Documents of a component that are verified together, about.
BLOCK = 256
#: Words of 64 bits of a sketch's parity bitmap.
_WORDS = 3
#: Digests that a task remembers to tell copies without a shuffle.
REMEMBERED = 50_000
PLACE = np.dtype([("v", "<u8"), ("doc_id", "<i8"), ("n", "<u4"), ("rest", "<u4"), ("bits", "<u8", _WORDS)])
#: Lowest lists of a member that its records carry, so that a pair is told in few of those that it shares.
LOWEST = 8
#: The same with the component, its size, whether the member looks for more candidates, and its lowest lists.
LABELLED = np.dtype([*PLACE.descr, ("root", "<i8"), ("size", "<i8"), ("seeks", "u1"), ("lowest", "<u8", LOWEST)])


def shingle_sets(buf: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each text's lower-cased words, ascending, one text after the other, and
    where each one's begin (one more: the end).  Fewer than k words are one shingle."""
    h, s, _ = word_hashes(buf, starts[:-1])
    at = np.append(np.searchsorted(s, starts[:-1]), len(s))
    words = np.diff(at)
    size = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(first[-1], np.uint64)
    runs = windows(h, k)
    for i in np.flatnonzero(words).tolist():
        x = out[first[i] : first[i + 1]]
        if words[i] >= k:
            x[:] = runs[at[i] : at[i + 1] - k + 1]
            x.sort()
        else:
            x[:] = windows(scramble(h[at[i] : at[i + 1]] ^ MIX), int(words[i]))
    of = np.repeat(np.arange(len(size)), size)
    new = np.append(np.ones(min(1, len(out)), bool), (out[1:] != out[:-1]) | (of[1:] != of[:-1]))
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(size)))])


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's lower-cased words."""
    return shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), k)[0]


def sketches(docs: DataFrame, k: int, sketch: int) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, a digest of the whole set, and its sketch as packed longs, ascending; null
    for an empty set, a null doc_id, or a set that the task has passed on already."""

    def fold(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            for low, high, buf, starts in lots(batch):
                h, first = shingle_sets(buf, starts, k)
                n = np.diff(first)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(scramble(x))]) for x in (h, h ^ MIX)]
                lo, hi = ((c[first[1:]] - c[first[:-1]]).view(np.int64) for c in sums)
                made = []
                for i, key in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    if not n[i] or null[low + i] or key in seen:
                        made.append(None)
                    else:
                        seen.add(key)
                        made.append(h[first[i] : min(first[i + 1], first[i] + sketch)].tobytes())
                yield {"doc_id": ids.slice(low, high - low), "n_shingles": n, "lo": lo, "hi": hi, "sketch": made}

    return per_task(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_shingles long, lo long, hi long, sketch binary", fold)


class Sketches:
    """The sketches of a batch, each in the order of rarity: values, their ranks, and where each one's begin."""

    def __init__(self, batch, place: np.ndarray):
        data, at = bytes_of(batch, "sketch")
        self.n, self.size = batch.column("n_shingles").to_numpy(), np.diff(at) // 8
        self.first = at[:-1] // 8
        values = np.frombuffer(data.tobytes(), np.uint64)
        rank, of = place.take((values & np.uint64(len(place) - 1)).astype(np.int64)), np.repeat(np.arange(len(self.size)), self.size)
        by = np.lexsort((values, rank, of))
        self.values, self.rank = values[by], rank[by]
        cell = values % np.uint64(64 * _WORDS)
        bit, word = np.uint64(1) << (cell & np.uint64(63)), cell >> np.uint64(6)
        self.bits = np.zeros((len(self.size), _WORDS), np.uint64)
        full = np.flatnonzero(self.size)
        if len(full):
            self.bits[full] = np.stack([np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), self.first[full]) for w in range(_WORDS)], 1)

    def listed(self, percent: int, sketch: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, m, n = percent / 100, self.size, self.n
        sd = np.sqrt(m * p * (1 - p) * drawn(n / p, sketch))
        need = np.where(n * 100 <= sketch * percent, -(-percent * n // 100), np.maximum(1, np.floor(p * m - SLACK_SD * sd))).astype(np.int64)
        # a set is listed if one with a shingle more or less could match it
        long = np.where((m > 0) & (percent < 100) & (n * 100 >= percent * (n + 1)), m - need + 1, 0)
        return listed(self.values, self.rank, self.first, m, long, hot)


def drawn(n: np.ndarray, sketch: int) -> np.ndarray:
    """What remains of the variance when a sketch's values are drawn from n without putting back."""
    return np.maximum((n - sketch) / np.maximum(n - 1, 1), 0)


def shared(a: np.ndarray, b: np.ndarray, percent: int, sketch: int) -> np.ndarray:
    """Values that the sketches of sets of sizes a and b share at least if they reach the threshold."""
    larger, both = np.maximum(a, b), percent * (a + b) / (100 + percent)
    part = np.minimum(both / larger, 1.0)
    return np.where(larger <= sketch, np.ceil(both - 1e-9), sketch * part - SLACK_SD * np.sqrt(sketch * part * (1 - part) * drawn(larger, sketch)))


class SketchLists(Lists):
    """Lists of documents by a retained value."""

    first = True

    def __init__(self, percent: int, sketch: int, hubs: int, kept: int):
        super().__init__(hubs, kept)
        self.percent, self.sketch = percent, sketch

    def possible(self, x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, k, a, b = self.percent, self.sketch, x["n"].take(i), x["n"].take(j)
        apart = np.bitwise_count(x["bits"][i] ^ x["bits"][j]).sum(1, dtype=np.int64)
        ok = (a * 100 >= p * b) & (b * 100 >= p * a) & (x["doc_id"].take(i) != x["doc_id"].take(j))
        labelled = "root" in x
        if labelled:
            ok &= x["root"].take(i) != x["root"].take(j)
        left = np.flatnonzero(ok)
        a, b, i, j = a[left], b[left], i[left], j[left]
        least = shared(a, b, p, k)
        ok[left] = apart[left] <= np.minimum(a, k) + np.minimum(b, k) - 2 * least
        if not labelled:
            ok[left] &= 1 + np.minimum(x["rest"].take(i), x["rest"].take(j)) >= least
            return ok, apart
        # what holds so far depends on the pair alone: where the two share a lower list, it holds there too
        left, i, j = left[ok[left]], i[ok[left]], j[ok[left]]
        for low in range(0, len(left), 1 << 16):
            part = slice(low, low + (1 << 16))
            one, other = x["lowest"][i[part]], x["lowest"][j[part]]
            below = (one < x["v"][i[part]][:, None])[:, :, None] & (one[:, :, None] == other[:, None, :])
            ok[left[part]] = ~below.any((1, 2))
        return ok, apart


def _bucket_count(df: DataFrame) -> int:
    return buckets(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _records(s: Sketches, ids: np.ndarray, which: np.ndarray, v: np.ndarray, pos: np.ndarray, kind: np.dtype) -> np.ndarray:
    made = np.zeros(len(v), kind)
    made["v"], made["doc_id"], made["n"], made["rest"], made["bits"] = v, ids[which], s.n[which], s.size[which] - 1 - pos, s.bits[which]
    return made


def _read(packed: bytes, kind: np.dtype) -> dict[str, np.ndarray]:
    """The records of lists of two or more, sorted by list, each document once in a list."""
    x = np.frombuffer(packed, kind)
    x = x[in_lists(x["v"])]
    seeks = x["seeks"] if "seeks" in kind.names else np.zeros(len(x), np.uint8)
    by = np.lexsort((x["doc_id"], seeks, x["v"]))
    x = x[by]
    x = x[np.append(np.ones(min(1, len(x)), bool), (x["v"][1:] != x["v"][:-1]) | (x["doc_id"][1:] != x["doc_id"][:-1]))]
    return {c: x[c].astype(np.float64) if c == "n" else np.ascontiguousarray(x[c]) for c in kind.names}


def candidates(rows: DataFrame, place: np.ndarray, lists: SketchLists, hot: int) -> DataFrame:
    """(doc_id, earlier, apart, more): of each list's members the nearest earlier ones that may match; earlier is null where
    a member far down a list has found none yet."""
    n = _bucket_count(rows)

    def deal(batches):
        for batch in batches:
            ids, s = batch.column("doc_id").to_numpy(), Sketches(batch, place)
            which, v, pos = s.listed(lists.percent, lists.sketch, hot_rank(hot))
            step = max(1, HELD // 2)
            for low in range(0, len(v), step):
                part = slice(low, low + step)
                out = list(dealt(_records(s, ids, which[part], v[part], pos[part], PLACE), v[part] >> np.uint64(20), n))
                yield {"bucket": np.array([b for b, _ in out], np.int32), "places": [p for _, p in out]}

    def read(batches):
        for _, places in gathered(batches, "places"):
            x = _read(places, PLACE)
            for i, j, rank, more in lists.pairs(x, x["v"]):
                apart = np.bitwise_count(x["bits"][i] ^ x["bits"][j]).sum(1, dtype=np.int64)
                yield {"doc_id": x["doc_id"][i], "earlier": x["doc_id"][j], "apart": np.where(rank < 0, -1, apart).astype(np.int32), "more": more}

    fresh = rows.filter("sketch is not null").select("doc_id", "n_shingles", "sketch")
    sent = per_task(fresh, "bucket int, places binary", deal)
    return per_task(sent.repartition("bucket").sortWithinPartitions("bucket"), "doc_id long, earlier long, apart int, more boolean", read)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, sketch: int = SKETCH, hubs: int = HUBS, kept: int = KEPT, hot: int = HOT) -> DataFrame:
    """A row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    rows = cut(sketches(docs, k, sketch))
    some = rows.filter("doc_id is not null and n_shingles > 0")
    # lead: of the class's documents that have passed on a sketch, the first
    classes = cut(some.groupBy("n_shingles", "lo", "hi").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("sketch").isNotNull(), F.col("doc_id"))).alias("lead")))
    comp = _components(rows, classes, docs, k, SketchLists(percent, sketch, hubs, kept), hot)
    labelled = classes.join(comp, F.col("lead") == F.col("node"), "left").withColumn("root", F.coalesce("root", "lead")).drop("node")
    lowest = labelled.groupBy("root").agg(F.min("rep").alias("component"))
    known = labelled.join(lowest, "root").select("n_shingles", "lo", "hi", "component")
    # a third of the rows may be copies of one text: the side with a row per class is salted against them
    salts = 16
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = rows.drop("sketch").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, ["n_shingles", "lo", "hi", "salt"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _components(rows: DataFrame, classes: DataFrame, docs: DataFrame, k: int, lists: SketchLists, hot: int) -> DataFrame:
    """(node, root) of the leads of classes that have a verified link."""
    place = rarity(sum_cells(rows.select("sketch"), CELLS, _values_per_cell))
    found = cut(candidates(rows, place, lists, hot))
    # what other tasks passed on of a class stands for its lead
    fresh = rows.filter("sketch is not null").select("doc_id", "n_shingles", "lo", "hi").join(classes, ["n_shingles", "lo", "hi"])
    alias = cut(fresh.filter("doc_id <> lead").select("doc_id", "lead"))
    per_doc = found.filter("apart >= 0").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("apart", "earlier"))).alias("near"))
    # the nearest two are verified first, and the first of all: in a group of near copies that one is every member's
    lead = F.array_min(F.col("near.earlier"))
    pairs = per_doc.select("doc_id", lead.alias("lead"), F.posexplode("near").alias("rank", "x")).select(F.col("doc_id").alias("a"), F.col("x.earlier").alias("b"), F.when(F.col("x.earlier") == F.col("lead"), 0).otherwise(F.col("rank")).alias("rank"))
    pairs = cut(_named(_named(pairs, alias, "a"), alias, "b").filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("rank").alias("rank")))
    sketch = rows.filter("sketch is not null").select("doc_id", "sketch")
    comp = components(_verified(pairs.filter("rank < 2"), sketch, docs, k, lists))
    seeking = cut(found.filter("more").select("doc_id").union(per_doc.filter(F.size("near") > 2).select("doc_id")).distinct())
    if not seeking.isEmpty():
        links = _beyond(rows, alias, seeking, comp, docs, k, place, lists, hot)
        comp = components(comp.toDF("a", "b").union(links))  # the ones so far are stars, so few rounds are needed
    return comp


def _values_per_cell(batches) -> np.ndarray:
    n = np.zeros(CELLS, np.int64)
    for batch in batches:
        values = np.frombuffer(bytes_of(batch, "sketch")[0].tobytes(), np.uint64)
        n += np.bincount((values & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return n


def _named(pairs: DataFrame, alias: DataFrame, name: str) -> DataFrame:
    """`pairs` with the column `name` put as its class's lead."""
    known = alias.toDF(name, "lead")
    return pairs.join(known, name, "left").withColumn(name, F.coalesce("lead", name)).drop("lead")


def _cell(ids: np.ndarray, cells: int) -> np.ndarray:
    return (scramble(ids.astype(np.uint64)) & np.uint64(cells - 1)).astype(np.int64)


def _of(df: DataFrame, ids: DataFrame, payload: str) -> DataFrame:
    """(doc_id, payload) of the rows of `df` whose id `ids` (doc_id) has, once each, and a few others: the tasks know the ids
    by marked cells of a hash, so little else is shuffled."""
    ids = cut(ids.distinct())
    cells = 1 << min(24, max(20, int(4 * ids.count()).bit_length()))
    bits = df.sparkSession.sparkContext.broadcast(mark_cells(ids, cells, lambda b: _cell(b.column("doc_id").to_numpy(), cells)))
    target = df.select("doc_id", payload).filter("doc_id is not null")

    def pick(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(marked(bits.value, _cell(batch.column("doc_id").to_numpy(), cells))))

    return target.mapInArrow(pick, target.schema).dropDuplicates(["doc_id"])


def _verified(pairs: DataFrame, sketch: DataFrame, docs: DataFrame, k: int, lists: SketchLists) -> DataFrame:
    """The pairs (a, b) that pass the estimate from the union's sketch and reach the threshold on whole texts.  Both sides of
    the joins grow with the corpus, so neither is ever broadcast."""
    p, size, percent = lists.percent / 100, lists.sketch, lists.percent
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("doc_id"))

    def met(df: DataFrame, payload: DataFrame) -> DataFrame:
        payload = payload.hint("merge")
        return df.select("a", "b").join(payload.toDF("a", "x"), "a").join(payload.toDF("b", "y"), "b")

    def estimate(batch):
        ok = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([s, t]))
            again = both[1:] == both[:-1]
            union = np.cumsum(np.append(True, ~again))  # how many distinct values there are up to each place
            m = min(size, int(union[-1]))
            ok.append(int((again & (union[1:] <= m)).sum()) >= max(1.0, p * m - SLACK_SD * (m * p * (1 - p)) ** 0.5))
        return {"a": batch.column("a"), "b": batch.column("b"), "ok": ok}

    def exact(batch):
        known, ok = {}, []
        for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            if len(known) > 256:
                known.clear()
            for i, t in ((a, x), (b, y)):
                if i not in known:
                    known[i] = shingles(t.encode(), k)
            ok.append(matches(known[a], known[b], percent))
        return {"a": batch.column("a"), "b": batch.column("b"), "ok": ok}

    close = cut(per_batch(met(pairs, _of(sketch, ends(pairs), "sketch")), "a long, b long, ok boolean", estimate).filter("ok"))
    texts = _of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ends(close), "text")
    return per_batch(met(close, texts), "a long, b long, ok boolean", exact).filter("ok").select("a", "b")


def matches(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if min(len(s), len(t)) * 100 < percent * max(len(s), len(t)):
        return False
    both = np.sort(np.concatenate([s, t]))
    n = int((both[1:] == both[:-1]).sum())
    return n > 0 and 100 * n >= percent * (len(s) + len(t) - n)


def _beyond(rows: DataFrame, alias: DataFrame, seeking: DataFrame, comp: DataFrame, docs: DataFrame, k: int, place: np.ndarray, lists: SketchLists, hot: int, cells: int = 1 << 20) -> DataFrame:
    """Links (a, b) of the documents of `seeking` to other components: their lists are dealt out once more, with each member's
    component; where two components may match, the member of the smaller one is verified against all of the larger."""
    n, percent, least = _bucket_count(rows), lists.percent, hot_rank(hot)
    seeks = mark_cells(seeking, cells, lambda b: _cell(b.column("doc_id").to_numpy(), cells))

    def lists_of(batch):
        s, at = Sketches(batch, place), marked(seeks, _cell(batch.column("doc_id").to_numpy(), cells))
        which, v, _ = s.listed(percent, lists.sketch, least)
        return (v[at[which]] & np.uint64(cells - 1)).astype(np.int64)

    fresh = rows.filter("sketch is not null").select("doc_id", "n_shingles", "sketch")
    wanted = mark_cells(fresh, cells, lists_of)

    def places(batch):
        ids, s = batch.column("doc_id").to_numpy(), Sketches(batch, place)
        which, v, pos = s.listed(percent, lists.sketch, least)
        use = marked(wanted, (v & np.uint64(cells - 1)).astype(np.int64))
        made = _records(s, ids, which[use], v[use], pos[use], LABELLED)
        made["seeks"] = marked(seeks, _cell(made["doc_id"], cells))
        by = np.lexsort((made["v"], which[use]))
        made = made[by]
        cuts = np.flatnonzero(np.append(True, which[use][by][1:] != which[use][by][:-1])[: len(made)]).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(made)], strict=False):
            first = made["v"][low : min(high, low + LOWEST)]
            made["lowest"][low:high] = np.append(first, np.full(LOWEST - len(first), first[-1], np.uint64))
        return {"doc_id": made["doc_id"][cuts], "places": [made[x:y].tobytes() for x, y in zip(cuts, [*cuts[1:], len(made)], strict=True)] if cuts else []}

    size = comp.groupBy("root").agg(F.count("*").alias("size"))
    sized = comp.join(size, "root").select(F.col("node").alias("lead"), "root", "size")
    few = per_batch(fresh, "doc_id long, places binary", places).join(alias, "doc_id", "left").withColumn("lead", F.coalesce("lead", "doc_id")).join(sized, "lead", "left")
    few = few.select("lead", F.coalesce("root", "lead").alias("root"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), "places")

    def deal(batches):
        for batch in batches:
            packed = batch.column("places").to_pylist()
            x = np.frombuffer(b"".join(packed), LABELLED).copy()
            times = [len(b) // LABELLED.itemsize for b in packed]
            for c, name in (("doc_id", "lead"), ("root", "root"), ("size", "size")):
                x[c] = np.repeat(batch.column(name).to_numpy(), times)
            out = list(dealt(x, x["v"] >> np.uint64(20), n))
            if out:
                yield {"bucket": np.array([b for b, _ in out], np.int32), "places": [p for _, p in out]}

    def read(batches):
        for _, packed in gathered(batches, "places"):
            x = _read(packed, LABELLED)
            for i, j, *_ in lists.pairs(x, x["v"], x["seeks"] == 1):
                low = x["size"][i] <= x["size"][j]
                small, other = np.where(low, i, j), np.where(low, j, i)
                met = np.unique(np.stack([x["doc_id"][small], x["root"][other], x["size"][other]], 1), axis=0)
                if len(met):
                    yield {"doc_id": met[:, 0], "root": met[:, 1], "size": met[:, 2]}

    sent = per_task(few, "bucket int, places binary", deal)
    asked = cut(per_task(sent.repartition("bucket").sortWithinPartitions("bucket"), "doc_id long, root long, size long", read).distinct())
    roots = asked.select("root", "size").distinct()
    members = cut(roots.join(comp, "root", "left").select("root", F.coalesce("node", "root").alias("doc_id"), "size"))
    ids = asked.select("doc_id").union(members.select("doc_id"))
    texts = _of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "text").hint("merge")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    held = members.join(texts, "doc_id").select("root", F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"), F.lit(0).alias("asks"), "doc_id", "text")
    asking = asked.join(texts, "doc_id").select("root", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("asks"), "doc_id", "text")

    def verify(batches):
        at, sets = None, []
        for batch in batches:
            a, b = [], []
            for root, block, asks, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("root", "block", "asks", "doc_id", "text")), strict=True):
                if at != (root, block):
                    at, sets = (root, block), []
                s = shingles(text.encode(), k)
                if not asks:
                    sets.append((doc_id, s))
                elif (hit := next((i for i, t in sets if matches(s, t, percent)), None)) is not None:
                    a.append(doc_id)
                    b.append(hit)
            yield {"a": np.array(a, np.int64), "b": np.array(b, np.int64)}

    both = held.union(asking).repartition("root", "block").sortWithinPartitions("root", "block", "asks")
    return per_task(both, "a long, b long", verify)
