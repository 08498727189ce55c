"""Language-model scoring by a Brown class-based bigram model.

Words are gathered into units: the `members` most frequent training words are units of their own, every other word
belongs to the unit of its ending.  Exchange clustering moves units between classes while that raises the likelihood of
the class bigrams of the whole training text.  Then every other training word is exchanged by itself, in one batch: from
the counts of the classes before and after it, it goes where its tokens are likeliest with the classes held fixed.  Only
a word that training has not seen keeps its ending's class.  Class bigrams are counted again under the final classes.  A
text's probability is the product over its tokens of P(class | class before) and P(word | class), both additively
smoothed; each class keeps one share for an unseen word.

All counts cover all training documents.  Words are told apart by 64-bit hashes; their counts and contexts travel as
packed records in buckets.  The `head` most frequent words are known to every task; the other words of a text are looked
up in the bucket that holds their counts and classes, a table that grows with the input.  Texts are read in blocks, whose
looked-up words come back to them in one more shuffle.

Defined results: null text is empty and has its end token only; very long texts are read in pieces and scored whole; tied
classes go to the lower number; repeated rows are scored alike; a null doc_id counts as any other id; without training
documents every count is 0 and all words are unknown; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import LOT, HashIndex, cut, lots, most_frequent, per_batch, per_task, scramble, sum_cells, word_hashes
from threadmill.llm.lists import buckets, dealt, gathered

HEAD, MEMBERS, ENDINGS, CLASSES, SWEEPS = 1 << 16, 384, 128, 24, 6
#: Stands for the end of a document among the words' hashes.
END = np.uint64(0)
#: Tokens that a task gathers before it deals out what it has counted.
HELD = 1 << 20
COUNT = np.dtype([("word", "<u8"), ("c", "<u4")])
#: A word, a slot (the class before it, or `classes` and the class after it), how often, and its ending's class.
CONTEXT = np.dtype([("word", "<u8"), ("slot", "u1"), ("ending", "u1"), ("n", "<u4")])
#: A word's count and class.
WORD = np.dtype([("word", "<u8"), ("c", "<u8"), ("cls", "u1")])
#: A word that a block asks for, and what it gets: at, the token's place in the block.
ASK = np.dtype([("word", "<u8"), ("block", "<u8"), ("at", "<u4")])
GOT = np.dtype([("block", "<u8"), ("at", "<u4"), ("c", "<u8"), ("cls", "u1")])
#: A document of a block.
DOC = np.dtype([("block", "<u8"), ("doc_id", "<i8"), ("null", "u1"), ("held_out", "u1"), ("n", "<u4"), ("known", "<u4"), ("logs", "<f8")])


@dataclass
class Tokens:
    """The tokens of some texts one after the other, each text's words and its end: hash, ending, text; first: where each
    text's begin."""

    hash: np.ndarray
    ending: np.ndarray
    text: np.ndarray
    first: np.ndarray


def tokens(buf: np.ndarray, starts: np.ndarray) -> Tokens:
    """Tokens of the texts of `buf`; an ending is a number below ENDINGS made of a word's last three bytes, and one more
    where the third last is within a character."""
    h, s, e = word_hashes(buf, starts[:-1])
    words = np.diff(np.append(np.searchsorted(s, starts[:-1]), len(s)))
    first = np.cumsum(words + 1) - words - 1
    text = np.repeat(np.arange(len(words)), words + 1)
    at = np.arange(len(h)) + np.repeat(np.arange(len(words)), words)
    out = Tokens(np.full(len(text), END), np.zeros(len(text), np.int64), text, first)
    out.hash[at] = np.maximum(h, np.uint64(1))
    if len(h):
        low = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
        back = lambda k: np.where(e - k >= s, low.take(np.maximum(e - k, 0)), 0).astype(np.uint64)
        third = back(3)
        fourth = np.where((third & np.uint64(192)) == 128, back(4), np.uint64(0))
        code = back(1) | back(2) << np.uint64(8) | third << np.uint64(16) | fourth << np.uint64(24)
        out.ending[at] = (scramble(code) % np.uint64(ENDINGS)).astype(np.int64)
    return out


def _partitions(df: DataFrame) -> int:
    return buckets(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of `docs`; word: a hash as a signed long, the end of a text included."""
    n = _partitions(docs)

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for *_, buf, starts in lots(batch):
                held.append(tokens(buf, starts).hash)
                size += len(held[-1])
                if size > HELD:
                    yield deal(held)
                    held, size = [], 0
        if held:
            yield deal(held)

    def deal(held):
        word, c = np.unique(np.concatenate(held), return_counts=True)
        made = np.empty(len(word), COUNT)
        made["word"], made["c"] = word, c
        out = list(dealt(made, word >> np.uint64(20), n))
        return {"bucket": np.array([b for b, _ in out], np.int32), "counts": [p for _, p in out]}

    def add(batches):
        for _, counts in gathered(batches, "counts"):
            x = np.frombuffer(counts, COUNT)
            word, of = np.unique(x["word"], return_inverse=True)
            yield {"word": word.view(np.int64), "c": np.bincount(of, x["c"]).astype(np.int64)}

    sent = per_task(docs.select("text"), "bucket int, counts binary", count)
    return per_task(sent.repartition("bucket").sortWithinPartitions("bucket"), "word long, c long", add)


def exchange(n: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit from the bigram counts n[before, after].  Unit 0 is class 0 alone; the others start in turn by
    frequency and each goes, sweep by sweep, where the class bigrams' likelihood is highest, until none moves."""
    u = len(n)
    total = n.sum(0) + n.sum(1)
    order = [i for i in np.argsort(-total, kind="stable") if i]
    of = np.zeros(u, np.int64)
    of[order] = np.arange(len(order)) % (classes - 1) + 1
    xlogx = lambda a: (a * np.log(np.maximum(a, 1))).sum()

    def value(g: np.ndarray) -> float:
        return xlogx(g) - xlogx(g.sum(0)) - xlogx(g.sum(1))

    hot = np.eye(classes)[of]
    g = hot.T @ n @ hot
    for _ in range(sweeps):
        moved = False
        for i in order:
            if not total[i]:
                continue
            after, before, own, a = n[i] @ hot, n[:, i] @ hot, n[i, i], of[i]
            after[a] -= own
            before[a] -= own
            rest = g.copy()
            rest[a] -= after
            rest[:, a] -= before
            rest[a, a] -= own
            best, at = -np.inf, a
            for b in [a, *(c for c in range(1, classes) if c != a)]:
                new = rest.copy()
                new[b] += after
                new[:, b] += before
                new[b, b] += own
                if (v := value(new)) > best + 1e-6:
                    best, at, kept = v, b, new
            if at != a:
                of[i], hot[i], moved = at, np.eye(classes)[at], True
            g = kept
        if not moved:
            break
    return of


def contexts(docs: DataFrame, members: np.ndarray, of: np.ndarray, classes: int) -> DataFrame:
    """(bucket, contexts): packed CONTEXTs of the words of `docs` that are no members; `of`: the units' classes."""
    n = _partitions(docs)

    def count(batches):
        index, held, size = HashIndex(members), [], 0
        for batch in batches:
            for *_, buf, starts in lots(batch):
                t = tokens(buf, starts)
                unit = _units(t, index)
                cls = of[unit]
                slot = np.stack([np.concatenate([of[:1], cls[:-1]]), np.concatenate([cls[1:], of[:1]]) + classes], 1)
                rare = np.flatnonzero(unit > len(members))
                held.append((t.hash[rare], slot[rare].astype(np.uint8), cls[rare].astype(np.uint8)))
                size += len(rare)
                if size > HELD:
                    yield deal(held)
                    held, size = [], 0
        if size:
            yield deal(held)

    def deal(held):
        word, slot, ending = (np.concatenate(x) for x in zip(*held, strict=True))
        word, first, which = np.unique(word, return_index=True, return_inverse=True)
        code, c = np.unique(np.concatenate([which * 256 + slot[:, k] for k in range(2)]), return_counts=True)
        made = np.empty(len(code), CONTEXT)
        at = code >> 8
        made["word"], made["slot"], made["ending"], made["n"] = word[at], code & 255, ending[first][at], c
        out = list(dealt(made, made["word"] >> np.uint64(20), n))
        return {"bucket": np.array([b for b, _ in out], np.int32), "contexts": [p for _, p in out]}

    return per_task(docs.select("text"), "bucket int, contexts binary", count)


def _units(t: Tokens, index: HashIndex) -> np.ndarray:
    """The unit of each token: 0 is the end, then the members, then the endings."""
    got = index.of(t.hash)
    return np.where(t.hash == END, 0, np.where(got >= 0, got + 1, len(index.keys) + 1 + t.ending))


def exchanged(seen: DataFrame, g: np.ndarray, head: np.ndarray) -> DataFrame:
    """(bucket, words, known, distinct): each word of `seen` (contexts) in the class in which its tokens are likeliest, the
    class bigrams g held fixed; its ending's class if that is as good.  Packed WORDs, those of them that `head` has, and how
    many there are in each class."""
    classes = len(g)
    t = np.log((g + 0.5) / (g + 0.5).sum(1, keepdims=True))
    gain, cost = np.concatenate([t, t.T]), np.log(g.sum(0) + 1)
    wanted = np.sort(head)

    def choose(batches):
        for bucket, packed in gathered(batches, "contexts"):
            x = np.frombuffer(packed, CONTEXT)
            word, first, of = np.unique(x["word"], return_index=True, return_inverse=True)
            m = np.bincount(of * (2 * classes) + x["slot"], x["n"], len(word) * 2 * classes).reshape(len(word), -1)
            c = m[:, :classes].sum(1)
            value = m @ gain - c[:, None] * cost
            value[:, 0] = -np.inf
            now, best, row = x["ending"][first].astype(np.int64), value.argmax(1), np.arange(len(word))
            stays = value[row, now] >= value[row, best] - 1e-9
            made = np.empty(len(word), WORD)
            made["word"], made["c"], made["cls"] = word, c, np.where(stays, now, best)
            known = made[np.isin(word, wanted, assume_unique=True)]
            yield {"bucket": np.array([bucket], np.int32), "words": [made.tobytes()], "known": [known.tobytes()], "distinct": [np.bincount(made["cls"], minlength=classes).tobytes()]}

    return per_task(seen.repartition("bucket").sortWithinPartitions("bucket"), "bucket int, words binary, known binary, distinct binary", choose)


@dataclass
class Model:
    head: np.ndarray  # hashes of the head words, the end first
    c: np.ndarray  # their counts
    cls: np.ndarray  # and classes
    endings: np.ndarray  # the endings' classes
    distinct: np.ndarray  # training words of each class
    n: int
    v: int


def fit(docs: DataFrame, counts: DataFrame, head: int = HEAD, members: int = MEMBERS, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The words' classes from all of `docs` and their `counts`, and (bucket, words) of all words that are no members; the
    driver holds `head` words and the units' bigram counts."""
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == 0, F.col("c"))), F.lit(0)).alias("ends")).first()
    frequent = {w: c for w, c in most_frequent(counts, head).items() if w}
    words = np.array(list(frequent), np.int64).view(np.uint64)
    chosen = words[:members]
    size = len(chosen) + 1 + ENDINGS

    def pairs(batches):
        index, n, held, tokens_held = HashIndex(chosen), np.zeros(size * size, np.int64), [], 0
        for batch in batches:
            for *_, buf, starts in lots(batch):
                u = _units(tokens(buf, starts), index)
                held.append(np.concatenate([[0], u[:-1]]) * size + u)
                tokens_held += len(u)
                if tokens_held > HELD:
                    n += np.bincount(np.concatenate(held), minlength=len(n))
                    held, tokens_held = [], 0
        return n + np.bincount(np.concatenate(held), minlength=len(n)) if held else n

    bigrams = sum_cells(docs.select("text"), size * size, pairs).reshape(size, size).astype(float)
    of = exchange(bigrams, classes)
    hot = np.eye(classes)[of]
    table = cut(exchanged(contexts(docs, chosen, of, classes), hot.T @ bigrams @ hot, words))
    cls = dict(zip(chosen.tolist(), of[1 : len(chosen) + 1].tolist(), strict=True))
    distinct = np.bincount(np.array([of[0], *cls.values()] if totals["ends"] else [], np.int64), minlength=classes)
    known = [np.frombuffer(r["known"], WORD) for r in table.filter(F.length("known") > 0).select("known").toLocalIterator()]
    cls |= {w: k for x in known for w, k in zip(x["word"].tolist(), x["cls"].tolist(), strict=True)}
    distinct = distinct + sum_cells(table.select("distinct"), classes, lambda batches: sum((np.frombuffer(x, np.int64) for b in batches for x in b.column("distinct").to_pylist()), np.zeros(classes, np.int64)))
    first = [np.array([x]) for x in (END, totals["ends"], of[0])]
    made = (words, np.array(list(frequent.values()), np.int64), np.array([cls[w] for w in words.tolist()], np.int64))
    return Model(*(np.concatenate(x) for x in zip(first, made, strict=True)), of[-ENDINGS:], distinct.astype(float), totals["n"], totals["v"]), table.select("bucket", "words")


def looked_up(rows: DataFrame, model: Model, table: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, logs, cls) of `rows` (doc_id, text, held_out): counted tokens, the sum of
    log10(count + 1) of all, and their classes, a byte each."""
    n = _partitions(rows)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    blocks = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")

    def ask(batches):
        m = shared.value
        index, logs, cls = HashIndex(m.head), np.log10(m.c + 1.0), m.cls.astype(np.uint8)
        endings = m.endings.astype(np.uint8)
        for batch in batches:
            row = batch.column("row").to_numpy()
            ids = batch.column("doc_id")
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for low, high, buf, starts in lots(batch, most=4 * LOT):
                t, block = tokens(buf, starts), scramble(row[low : low + 1].astype(np.uint64))[0]
                got = index.of(t.hash)
                is_head = got >= 0
                docs = np.zeros(high - low, DOC)
                docs["block"], docs["doc_id"], docs["null"], docs["held_out"] = block, ids[low:high], null[low:high], held[low:high]
                docs["n"] = np.bincount(t.text, minlength=high - low)
                docs["known"] = np.bincount(t.text, is_head & (m.c.take(got) > 0), high - low)
                docs["logs"] = np.bincount(t.text, np.where(is_head, logs.take(got), 0.0), high - low)
                rare = np.flatnonzero(~is_head)
                want = np.empty(len(rare), ASK)
                want["word"], want["block"], want["at"] = t.hash[rare], block, rare
                seq = np.where(is_head, cls.take(got), endings.take(t.ending))
                out = list(dealt(want, want["word"] >> np.uint64(20), n))
                yield {"bucket": np.array([int(block % np.uint64(n)), *(b for b, _ in out)], np.int32), "docs": [docs.tobytes(), *[None] * len(out)], "seq": [seq.tobytes(), *[None] * len(out)], "asked": [None, *(p for _, p in out)]}

    def answer(batches):
        for _, docs, seq, asked, words in gathered(batches, "docs", "seq", "asked", "words"):
            a, w = np.frombuffer(asked, ASK), np.frombuffer(words, WORD)
            at = np.minimum(np.searchsorted(w["word"], a["word"]), max(0, len(w) - 1))  # words are sorted
            hit = w["word"][at] == a["word"] if len(w) else np.zeros(len(a), bool)
            a, w = a[hit], w[at[hit]]
            made = np.empty(len(a), GOT)
            made["block"], made["at"], made["c"], made["cls"] = a["block"], a["at"], w["c"], w["cls"]
            out = list(dealt(made, a["block"], n))
            yield {"bucket": np.array([b for b, _ in out], np.int32), "docs": [None] * len(out), "seq": [None] * len(out), "got": [p for _, p in out]}
            d = np.frombuffer(docs, DOC)
            if len(d):  # whole blocks, which go on
                ends = np.flatnonzero(np.append(d["block"][1:] != d["block"][:-1], True)) + 1
                tokens_at = np.concatenate([[0], np.cumsum(d["n"], dtype=np.int64)])
                cuts = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
                yield {"bucket": (d["block"][ends - 1] % np.uint64(n)).astype(np.int32), "docs": [d[x:y].tobytes() for x, y in cuts], "seq": [seq[tokens_at[x] : tokens_at[y]] for x, y in cuts], "got": [None] * len(cuts)}

    def fill(batches):
        for _, docs, seq, got in gathered(batches, "docs", "seq", "got"):
            d, g, c = np.frombuffer(docs, DOC), np.frombuffer(got, GOT), np.frombuffer(seq, np.uint8).copy()
            g = g[np.lexsort((g["at"], g["block"]))]
            ends = np.cumsum(d["n"], dtype=np.int64)
            new = np.flatnonzero(np.append(np.ones(min(1, len(d)), bool), d["block"][1:] != d["block"][:-1]))
            by = np.argsort(d["block"][new])
            base = (ends - d["n"])[new][by][np.searchsorted(d["block"][new][by], g["block"])] if len(g) else np.empty(0, np.int64)
            at = base + g["at"]
            c[at] = g["cls"]
            doc = np.searchsorted(ends, at, "right")
            known = d["known"] + np.bincount(doc, minlength=len(d)).astype(np.int64)
            logs = d["logs"] + np.bincount(doc, np.log10(g["c"] + 1.0), len(d))
            done, ends = c.tobytes(), ends.tolist()
            yield {
                "doc_id": pa.array(d["doc_id"], mask=d["null"] == 1), "held_out": pa.array(d["held_out"] == 1), "n_tokens": d["n"].astype(np.int64), "n_known": known, "logs": logs,
                "cls": [done[e - k : e] for e, k in zip(ends, d["n"].tolist(), strict=True)],
            }

    asked = per_task(blocks, "bucket int, docs binary, seq binary, asked binary", ask).withColumn("words", F.lit(None).cast("binary"))
    none = F.lit(None).cast("binary")
    met = asked.union(table.select("bucket", none.alias("docs"), none.alias("seq"), none.alias("asked"), "words")).repartition("bucket").sortWithinPartitions("bucket")
    answered = per_task(met, "bucket int, docs binary, seq binary, got binary", answer).repartition("bucket").sortWithinPartitions("bucket")
    return per_task(answered, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, cls binary", fill)


def class_bigrams(resolved: DataFrame, classes: int) -> np.ndarray:
    """Bigram counts of the classes over the training rows of `resolved`."""

    def count(batches):
        n = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for _, _, seq, _ in lots(batch, "cls"):  # each ends with the end token, whose class is 0
                c = seq.astype(np.int64)
                n += np.bincount(np.concatenate([[0], c[:-1]]) * classes + c, minlength=len(n))
        return n

    return sum_cells(resolved.filter("not held_out").select("cls"), classes * classes, count).reshape(classes, classes).astype(float)


def emissions(g: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """log10 of what each class's tokens, one more for each of its words and for an unseen one, add up to: a word's chance
    in its class is its count + 1 over that."""
    return np.log10(g.sum(0) + distinct + 1)


def score_texts(docs: DataFrame, held_out: Column, head: int = HEAD, members: int = MEMBERS, classes: int = CLASSES) -> DataFrame:
    """Learn from the rows of `docs` (doc_id, text) that are not `held_out`; score all of them: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score (unigram, add-one), score (class model), both log10, and perplexity."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    train = rows.filter(~F.col("held_out"))
    model, table = fit(train, cut(count_words(train)), head, members, classes)
    resolved = cut(looked_up(rows, model, table))
    g = class_bigrams(resolved, classes)
    transition = np.log10((g + 0.5) / (g + 0.5).sum(1, keepdims=True))
    chance = (transition - emissions(g, model.distinct)).ravel()  # of a class after another, over its tokens and shares

    def judge(batch):
        out = []
        for low, high, seq, starts in lots(batch, "cls"):
            c = seq.astype(np.int64)
            out.append(np.add.reduceat(chance[np.concatenate([[0], c[:-1]]) * classes + c], starts[:-1]))
        return {**{k: batch.column(k) for k in batch.schema.names if k != "cls"}, "model": np.concatenate(out)}

    judged = per_batch(resolved, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double", judge)
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(model.n + model.v + 1))
    score = F.col("logs") + F.col("model")
    return judged.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
