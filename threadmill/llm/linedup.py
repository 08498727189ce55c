"""Line dedup: an exact set-similarity join of all lines, removing the later of two that match.

A line is the set of its lower-cased words; lines without words are left alone.  A line is removed if an earlier line,
in the order of (doc_id, line number), has the same set or a Jaccard similarity of `percent` or more.

1. A first pass counts words in cells of their hash.  The cells' counts order all words by rarity, words of like counts by
   hash.  Any fixed order gives exact results, this one makes lists short.
2. Each line's words are put in that order.  A line of m words is listed under its first m - ceil(t m) + 1 words (prefix
   filter).  A word in a cell of more than `hot` words is listed together with each later word of the prefix, one word
   longer: two lines that match and share first a hot word share a second word there.  So a list of one word has `hot`
   members at most, whatever the corpus.
3. Postings travel as packed records in buckets.  In each list every line is compared with those whose sizes can match, which
   stand next to each other.  The positional filter and a parity bitmap (a bound of the symmetric difference; wider for long lines) leave
   candidate pairs, which are verified on whole lines: first the nearest by bitmap, then the others of the lines that
   have not matched.  What of them has more candidates than are kept, or a list in which too many sizes fit, is then compared with
   all earlier members of its lists.

Words are told apart by 64-bit hashes up to the verification, which compares the words themselves.  Lines with one set are
found by a digest of 128 bits; each task passes on a set's first line only, so a line that fills a third of the corpus
makes a few records of each task.

Defined results: null text has no lines and stays null; empty text stays empty; very long texts and lines are read in
pieces and compared whole; of lines that tie (equal sets) the first stays; repeated rows of a doc_id are one document and
get the same result; a null doc_id neither removes nor loses lines; a document that loses all its lines stays with empty
text; an empty table gives an empty result; other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import MIX, cut, id_bit, lots, mark_cells, marked, near_ids, per_batch, per_task, quoted, scramble, sum_cells, utf8, word_hashes
from threadmill.llm.lists import HELD, PAIRS, Lists, buckets, dealt, gathered, hot_rank, in_lists, listed, rarity

PERCENT = 80
#: Cells in which words are counted, and counts above which a word is listed with a second one.
CELLS, HOT = 1 << 18, 1 << 16
#: Lines of a list that a line is compared with at first, and candidates that are kept of them.
HUBS, KEPT = 4096, 4
#: Sets that a task remembers to tell copies without a shuffle.
REMEMBERED = 50_000
#: Hashes by which the tasks know the lines whose texts are wanted.
HASHES = 4
#: Lines above this many words have the wide bitmap.
NARROW = 100
#: A line of a set, and a line in a list; wide: the rest of its bitmap.
SET = np.dtype([("lo", "<u8"), ("hi", "<u8"), ("doc_id", "<i8"), ("line", "<i4")])
PLACE = np.dtype([("word", "<u8"), ("doc_id", "<i8"), ("line", "<i4"), ("m", "<i4"), ("pos", "<i4"), ("bits", "<u8")])
WIDE = np.dtype([*PLACE.descr, ("rest", "<u8", 3)])


def word_cells(docs: DataFrame, cells: int = CELLS) -> np.ndarray:
    """How many words of all texts fall into each cell of the hash."""

    def count(batches):
        n, held, size = np.zeros(cells, np.int64), [], 0
        for batch in batches:
            for *_, buf, starts in lots(batch):
                held.append((word_hashes(buf, starts[:-1])[0] & np.uint64(cells - 1)).astype(np.int64))
                size += len(held[-1])
                if size > HELD:
                    n += np.bincount(np.concatenate(held), minlength=cells)
                    held, size = [], 0
        return n + np.bincount(np.concatenate(held), minlength=cells) if held else n

    return sum_cells(docs.select("text"), cells, count)


def line_starts(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line, first byte) of all lines of the texts of `buf`; a line begins with its text or behind an end of line."""
    ends = np.flatnonzero(buf == 10)
    at = np.concatenate([ends + 1, starts])
    doc = np.concatenate([np.searchsorted(starts, ends, "right") - 1, np.arange(len(starts))])
    by = np.argsort(at, kind="stable")  # at one place, that of the earlier text comes first
    doc = doc[by]
    return doc, np.arange(len(by)) - np.flatnonzero(by >= len(ends))[doc], at[by]


class Lines:
    """The lines with words of some texts, as sets of word hashes in the order of rarity.

    doc: the text's number; line: its number there; m: distinct words; words: their hashes, line by line, from `first`."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, place: np.ndarray):
        h, s, _ = word_hashes(buf, starts)
        doc, line, at = line_starts(buf, starts)
        size = np.diff(np.append(np.searchsorted(s, at), len(s)))
        full = size > 0
        self.doc, self.line, size = doc[full], line[full].astype(np.int32), size[full]
        of = np.repeat(np.arange(len(size), dtype=np.uint64), size)
        rank = place.take((h & np.uint64(len(place) - 1)).astype(np.int64))
        key = (of << np.uint64(44)) | (rank.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28))
        order = np.argsort(key)
        key, sorted_h = key.take(order), h.take(order)
        same = key[1:] == key[:-1]
        if len(size) >= 1 << 20 or (same & (sorted_h[1:] != sorted_h[:-1])).any():  # the key is too short to tell all
            order = np.lexsort((h, rank, of))
            sorted_h = h[order]
            same = (sorted_h[1:] == sorted_h[:-1]) & (of[order][1:] == of[order][:-1])
        new = np.append(np.ones(min(1, len(h)), bool), ~same)
        self.words, self.rank = sorted_h[new], rank[order][new]
        self.m = np.bincount(of[order][new].astype(np.int64), minlength=len(size))
        self.first = np.cumsum(self.m) - self.m

    def __len__(self) -> int:
        return len(self.m)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        return np.add.reduceat(scramble(self.words), self.first), np.add.reduceat(scramble(self.words ^ MIX), self.first)

    def parity(self) -> np.ndarray:
        """For each line, 4 x 64 bits: of each cell whether an odd number of its words falls there."""
        cell = scramble(self.words) >> np.uint64(56)
        bit, word = np.uint64(1) << (cell & np.uint64(63)), cell >> np.uint64(6)
        return np.stack([np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), self.first) for k in range(4)], 1)

    def listed(self, percent: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, list, place in the line) under which the lines are listed; `hot`: the least rank of hot words."""
        m = self.m
        long = np.where((percent < 100) & (m * 100 >= percent * (m + 1)), m - (m * percent + 99) // 100 + 1, 0)
        return listed(self.words, self.rank, self.first, m, long, hot)


def postings(docs: DataFrame, place: np.ndarray, percent: int, hot: int, some: np.ndarray | None = None) -> DataFrame:
    """(bucket, copies, sets, narrow, wide): of each bucket the lines whose set the task had in an earlier line, else their
    digests, and their places in lists; all packed.  With `some`, marked cells of lists that are wanted, places only."""
    n = buckets(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shared, least = docs.sparkSession.sparkContext.broadcast((place, some)), hot_rank(hot)

    def deal(held):
        out: dict[int, list[bytes | None]] = {}
        for k, (records, by) in enumerate(held):
            if records:
                for bucket, packed in dealt(np.concatenate(records), np.concatenate(by), n):
                    out.setdefault(bucket, [None] * 4)[k] = packed
        return {"bucket": np.array(list(out), np.int32), **{c: [x[k] for x in out.values()] for k, c in enumerate(("copies", "sets", "narrow", "wide"))}}

    def split(batches):
        place, some = shared.value
        seen: dict[bytes, tuple[int, int]] = {}
        held, size = [([], []) for _ in range(4)], 0

        def put(k, records, by):
            held[k][0].append(records)
            held[k][1].append(by)
            return len(records)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for low, high, buf, starts in lots(batch):
                lines = Lines(buf, starts[:-1], place)
                if not len(lines):
                    continue
                doc_id, fresh = ids[low:high][lines.doc], np.ones(len(lines), bool)
                if some is None:
                    lo, hi = lines.digests()
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    at = zip(doc_id.tolist(), lines.line.tolist(), strict=True)
                    for i, (key, place_of) in enumerate(zip(np.stack([lo, hi], 1).view("V16").ravel().tolist(), at, strict=True)):
                        first = seen.setdefault(key, place_of)
                        if first < place_of:
                            fresh[i] = False
                        elif place_of < first:
                            seen[key] = place_of
                    made = np.empty(len(lines), SET)
                    made["lo"], made["hi"], made["doc_id"], made["line"] = lo, hi, doc_id, lines.line
                    copy = made[~fresh]
                    size += put(0, copy, scramble(copy["doc_id"].astype(np.uint64) + MIX)) + put(1, made[fresh], lo[fresh])
                line, word, pos = lines.listed(percent, least)
                use = fresh[line] if some is None else marked(some, (word & np.uint64(8 * len(some) - 1)).astype(np.int64))
                line, word, pos = line[use], word[use], pos[use]
                bits, wide = lines.parity(), lines.m[line] > NARROW
                for k, kind, which in ((2, PLACE, ~wide), (3, WIDE, wide)):
                    at = line[which]
                    made = np.empty(len(at), kind)
                    made["word"], made["doc_id"], made["line"], made["m"], made["pos"] = word[which], doc_id[at], lines.line[at], lines.m[at], pos[which]
                    made["bits"] = np.bitwise_xor.reduce(bits, 1)[at]
                    if k == 3:
                        made["rest"] = bits[at, 1:]
                    size += put(k, made, word[which] >> np.uint64(20))
                if size > HELD:
                    yield deal(held)
                    held, size = [([], []) for _ in range(4)], 0
        if size:
            yield deal(held)

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_task(rows, "bucket int, copies binary, sets binary, narrow binary, wide binary", split)


class LineLists(Lists):
    """Lists of lines, in each list by their sizes, so that a line meets those alone whose sizes can match."""

    def __init__(self, percent: int, hubs: int, kept: int):
        super().__init__(hubs, kept)
        self.percent = percent

    def pairs(self, x: dict[str, np.ndarray], key: np.ndarray, whole: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """As of `Lists`, of rows sorted by list and size; the later line of a pair is the member.  A line is compared with the `hubs` rows
        before it whose sizes fit; where one has more of them, all members of its list are compared again."""
        n, p = len(key), self.percent
        if not n:
            return
        new = np.append(True, key[1:] != key[:-1])
        of, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        at, rows = (of << 32) + x["m"], np.arange(n)
        low = np.searchsorted(at, (of << 32) + (p * x["m"] + 99) // 100)
        high, cut = rows, np.zeros(len(starts), bool)
        if whole is None:
            cut[of[rows - low > self.hubs]] = True
            low = np.maximum(low, rows - self.hubs)
        else:
            high = np.where(whole, np.searchsorted(at, (of << 32) + 100 * x["m"] // p, "right"), low)
        order = np.lexsort((x["line"], x["doc_id"]))
        when = np.empty(n, np.int64)
        when[order] = rows
        span = high - low
        done = np.cumsum(span)
        ends, begin = np.append(starts[1:], n), 0
        while begin < len(starts):  # whole lists of about PAIRS pairs, or one
            first = starts[begin]
            past = max(begin + 1, int(np.searchsorted(done[ends - 1], done[first] - span[first] + PAIRS, "right")))
            last, held, size = ends[past - 1], [], 0
            while first < last:  # of one long list, some rows at a time
                to = max(first + 1, min(last, int(np.searchsorted(done, done[first] - span[first] + PAIRS, "right"))))
                i = np.repeat(rows[first:to], span[first:to])
                j = np.arange(len(i)) - np.repeat(done[first:to] - span[first:to] - (done[first] - span[first]) - low[first:to], span[first:to])
                first = to
                if whole is not None:
                    i, j = i[when[j] < when[i]], j[when[j] < when[i]]
                ok, apart = self.possible(x, i, j)
                i, j, apart = i[ok], j[ok], apart[ok]
                swap = when[i] < when[j]
                held.append((np.where(swap, j, i), np.where(swap, i, j), apart))
                size += len(i)
                if whole is not None:
                    yield self._ranked(*held.pop(), None, True)
                elif size > 4 * PAIRS:  # one candidate more than are kept tells that there were others
                    i, j, apart = (np.concatenate([h[k] for h in held]) for k in range(3))
                    by = np.lexsort((j, apart, i))
                    i = i[by]
                    nth = np.arange(len(i)) - np.searchsorted(i, i)
                    by = by[nth <= self.kept]
                    i = i[nth <= self.kept]
                    held, size = [(i, j[by], apart[by])], 0
            if whole is None:
                far = np.flatnonzero(cut[of[starts[begin] : last]]) + starts[begin]
                if held:
                    yield self._ranked(*(np.concatenate([h[k] for h in held]) for k in range(3)), far, False)
            begin = past

    def possible(self, x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs (i, j) can reach the threshold, and how many bits they differ in."""
        p, m, n = self.percent, x["m"].take(i), x["m"].take(j)
        apart = np.bitwise_count(x["bits"].take(i) ^ x["bits"].take(j)).astype(np.int64)
        ok = (apart * (100 + p) <= (100 - p) * (m + n)) & (m * 100 >= p * n) & (n * 100 >= p * m)
        left = np.flatnonzero(ok)
        i, j, both = i[left], j[left], (m + n)[left]
        places = np.minimum(m[left] - x["pos"].take(i), n[left] - x["pos"].take(j))
        ok[left] = (places * (100 + p) >= p * both) & ((x["doc_id"].take(i) != x["doc_id"].take(j)) | (x["line"].take(i) != x["line"].take(j)))
        far = np.flatnonzero(ok[left] & (x["at"].take(i) >= 0) & (x["at"].take(j) >= 0))
        if len(far):
            i, j = i[far], j[far]
            differ = x["rest"][x["at"][i]] ^ x["rest"][x["at"][j]]
            first = x["bits"][i] ^ x["bits"][j] ^ np.bitwise_xor.reduce(differ, 1)
            apart[left[far]] = bits = np.bitwise_count(differ).sum(1, dtype=np.int64) + np.bitwise_count(first)
            ok[left[far]] = bits * (100 + p) <= (100 - p) * both[far]
        return ok, apart


def read_lists(rows: DataFrame, lists: LineLists, only: np.ndarray | None = None) -> DataFrame:
    """Reads postings by bucket: (doc_id, line, earlier_doc_id, earlier_line, rank, more); rank -2: a copy, removed.  With
    `only`, marked cells of lines: candidates of such lines alone, and all they have."""

    def same(copies, sets):
        copy, s = np.frombuffer(copies, SET), np.frombuffer(sets, SET)
        s = s[np.lexsort((s["line"], s["doc_id"], s["hi"], s["lo"]))]
        new = np.append(np.ones(min(1, len(s)), bool), (s["lo"][1:] != s["lo"][:-1]) | (s["hi"][1:] != s["hi"][:-1]))
        first = s[np.flatnonzero(new)[np.cumsum(new) - 1]]  # of the same set; a document's repeated row is no copy of itself
        return np.concatenate([copy, s[(s["doc_id"] != first["doc_id"]) | (s["line"] != first["line"])]])

    def read(batches):
        for _, copies, sets, narrow, wide in gathered(batches, "copies", "sets", "narrow", "wide"):
            if copies or sets:
                gone = same(copies, sets)
                none = np.zeros(len(gone), np.int64)
                yield {"doc_id": gone["doc_id"], "line": gone["line"], "earlier_doc_id": none, "earlier_line": none.astype(np.int32), "rank": none.astype(np.int32) - 2, "more": none > 0}
            a, b = np.frombuffer(narrow, PLACE), np.frombuffer(wide, WIDE)
            x = {c: np.concatenate([a[c], b[c]]) for c in PLACE.names}
            x["at"] = np.concatenate([np.full(len(a), -1), np.arange(len(b))])
            shared = in_lists(x["word"])
            order = shared[np.lexsort((x["m"][shared], x["word"][shared]))]
            x = {c: v[order] for c, v in x.items()} | {"rest": b["rest"]}
            x["m"], x["pos"] = x["m"].astype(np.int64), x["pos"].astype(np.int64)
            whole = None if only is None else marked(only, mark(x["doc_id"], x["line"], 8 * len(only)))
            for i, j, rank, more in lists.pairs(x, x["word"], whole):
                if len(i):
                    yield {"doc_id": x["doc_id"][i], "line": x["line"][i], "earlier_doc_id": x["doc_id"][j], "earlier_line": x["line"][j], "rank": rank, "more": more}

    return per_task(rows.repartition("bucket").sortWithinPartitions("bucket"), "doc_id long, line int, earlier_doc_id long, earlier_line int, rank int, more boolean", read)


def mark(doc_id: np.ndarray, line: np.ndarray, cells: int, nth: int = 0) -> np.ndarray:
    """The cell of a line; `nth`: in another hash."""
    h = scramble(scramble(doc_id.astype(np.uint64)) + line.astype(np.uint64))
    return ((h + np.uint64(nth) * (h >> np.uint64(32) | np.uint64(1))) & np.uint64(cells - 1)).astype(np.int64)


def picked(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(x, text): the lines of `need` (x: doc_id, line), once each, and a few others.  The tasks that read the texts know the
    wanted lines by marked cells of `HASHES` hashes; the cells' number goes with the lines', so the others stay a few in a hundred."""
    cells = 1 << min(27, max(20, int(8 * need.count()).bit_length()))

    def cells_of(batch):
        ids, line = batch.column("doc_id").to_numpy(), batch.column("line").to_numpy()
        return np.concatenate([mark(ids, line, cells, k) for k in range(HASHES)])

    bits = mark_cells(need.select("x.doc_id", "x.line"), cells, cells_of, max(16, cells >> 17))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def pick(batch):
        ids = batch.column("doc_id").to_numpy()
        out = {"doc_id": [], "line": [], "text": []}
        for low, high, buf, starts in lots(batch):
            doc, line, first = line_starts(buf, starts[:-1])
            doc_id = ids[low:high][doc]
            want = np.arange(len(line))
            for k in range(HASHES):
                want = want[marked(shared.value, mark(doc_id[want], line[want], cells, k))]
            ends = np.append(first[1:], len(buf))[want]
            out["doc_id"].append(doc_id[want])
            out["line"].append(line[want].astype(np.int32))
            out["text"] += [buf[x:y].tobytes() for x, y in zip(first[want].tolist(), ends.tolist(), strict=True)]
        return {"doc_id": np.concatenate(out["doc_id"]), "line": np.concatenate(out["line"]), "text": out["text"]}

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_batch(rows, "doc_id long, line int, text binary", pick).dropDuplicates(["doc_id", "line"]).select(F.struct("doc_id", "line").alias("x"), "text")


def _verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(at) of the later lines of `pairs` (at, earlier) that reach the threshold; at and earlier: (doc_id, line).  Both sides
    of the joins grow with the corpus, so neither is ever broadcast."""
    lines = cut(picked(docs, cut(pairs.select(F.explode(F.array("at", "earlier")).alias("x")).distinct()))).hint("merge")
    joined = pairs.join(lines.toDF("at", "text"), "at").join(lines.toDF("earlier", "other"), "earlier").select("at.doc_id", "at.line", "text", "other")

    def exact(batch):
        ok = []
        for x, y in zip(utf8(batch, "text"), utf8(batch, "other"), strict=True):
            s, t = set(x.lower().split()), set(y.lower().split())
            both = len(s & t)
            ok.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
        return {"doc_id": batch.column("doc_id"), "line": batch.column("line"), "ok": ok}

    hit = per_batch(joined, "doc_id long, line int, ok boolean", exact).filter("ok")
    return hit.select(F.struct("doc_id", "line").alias("at")).distinct()


def matched_lines(docs: DataFrame, percent: int = PERCENT, hubs: int = HUBS, kept: int = KEPT, hot: int = HOT, cells: int = CELLS) -> DataFrame:
    """(doc_id, line) of every line of `docs` (doc_id, text) that an earlier one matches."""
    place = rarity(word_cells(docs, cells))
    lists = LineLists(percent, hubs, kept)
    found = cut(read_lists(postings(docs, place, percent, hot), lists))
    copies = found.filter("rank = -2").select(F.struct("doc_id", "line").alias("at")).distinct()
    pairs = found.filter("rank > -2").select(F.struct("doc_id", "line").alias("at"), F.struct(F.col("earlier_doc_id").alias("doc_id"), F.col("earlier_line").alias("line")).alias("earlier"), "rank", "more")
    pairs = cut(pairs.join(copies.hint("merge"), "at", "left_anti"))
    matched = cut(_verify(cut(pairs.filter("rank between 0 and 1").select("at", "earlier").distinct()), docs, percent))
    others = cut(pairs.filter("rank > 1").join(matched, "at", "left_anti").select("at", "earlier").distinct())
    if not others.isEmpty():
        matched = cut(matched.union(_verify(others, docs, percent)).distinct())
    beyond = cut(pairs.filter("more").select("at").distinct().join(matched, "at", "left_anti"))
    if not beyond.isEmpty():
        matched = matched.union(_verify(cut(_beyond(docs, beyond, place, percent, hot, lists)), docs, percent))
    return copies.union(matched).select("at.doc_id", "at.line").distinct()


def _beyond(docs: DataFrame, lines: DataFrame, place: np.ndarray, percent: int, hot: int, lists: LineLists, cells: int = 1 << 20) -> DataFrame:
    """All candidate pairs (at, earlier) of `lines` (at): their lists are dealt out once more, and read for them alone.  The
    lines and their lists are told to the tasks as cells of a hash, whose number is fixed."""

    def lists_of(batch):
        out = []
        for *_, buf, starts in lots(batch):
            lines = Lines(buf, starts[:-1], place)
            if len(lines):
                out.append(lines.listed(percent, hot_rank(hot))[1])
        words = np.concatenate(out) if out else np.empty(0, np.uint64)
        return (words & np.uint64(cells - 1)).astype(np.int64)

    only = mark_cells(lines.select("at.doc_id", "at.line"), cells, lambda b: mark(b.column("doc_id").to_numpy(), b.column("line").to_numpy(), cells))
    some = mark_cells(picked(docs, lines.select(F.col("at").alias("x"))).select("text"), cells, lists_of)
    found = read_lists(postings(docs, place, percent, hot, some), lists, only)
    pair = found.select(F.struct("doc_id", "line").alias("at"), F.struct(F.col("earlier_doc_id").alias("doc_id"), F.col("earlier_line").alias("line")).alias("earlier"))
    return pair.distinct().join(lines, "at", "left_semi")


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row per document that loses lines: doc_id, removed (its line numbers from 0, ascending)."""
    return matched_lines(docs, percent).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """`docs`, all columns, with the lines of `removed` taken out of text."""
    whole = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("doc")).withColumn("bit", id_bit(F.col("doc.doc_id").cast("long")))
    gone = cut(removed.select("doc_id", "removed"))
    kept = F.filter(F.split("doc.text", "\n", -1), lambda x, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(F.array_join(kept, "\n"))
    bits = near_ids(gone)
    # documents that surely lose nothing are not shuffled
    some = whole.join(bits, "bit", "left_semi").join(gone, F.col("doc.doc_id") == F.col("doc_id"), "left")
    changed = some.select(*(text.alias(c) if c == "text" else F.col(f"doc.{quoted(c)}") for c in docs.columns))
    return whole.join(bits, "bit", "left_anti").select("doc.*").union(changed)
