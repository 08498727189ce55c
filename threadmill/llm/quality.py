"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio between a trusted target and the
raw corpus.

Words and pairs of neighbouring words are hashed to `buckets` cells.  The raw multinomial counts every document; the
target multinomial counts a bounded, fixed sample of trusted documents.  A document's score is the mean over its
n-grams of log p_target - log p_raw; it is kept if the score reaches `threshold`, the same for every document.

Defined results: null or blank text has no words, score 0 and fails the base rule; repeated rows are scored alike; an
empty table gives an empty result; with no trusted document the target falls back to the raw counts, so every score is 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import MIX, hashes, per_batch, per_task, scramble, top_by_hash, utf8, windows

BUCKETS = 1 << 16
THRESHOLD = -0.25
MIN_WORDS, MAX_REPEAT = 10, 20
#: Trusted documents that the target is counted over.
TRUSTED = 8192
_SPACE, _SYMBOL, _INNER = 1, 2, 4


def _classes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[[32, *range(9, 14)]] = _SPACE
    t[list(b"#*$%&|<>")] = _SYMBOL
    t[128:192] = _INNER
    return t


def cells(words: list[bytes], buckets: int) -> np.ndarray:
    h = hashes(words)
    return (np.concatenate([scramble(h ^ MIX), windows(h, 2)]) % np.uint64(buckets)).astype(np.int64)


def repeated_words(h: np.ndarray, k: int = 5) -> int:
    """Words that lie in a window of k words that occurs twice or more."""
    w = windows(h, k)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w) + 1, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge) > 0).sum())


def cell_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(cell, n) over the words and word pairs of all of `docs`: each task sends a row per cell at most."""

    def count(batches):
        n, waiting, held = np.zeros(buckets, np.int64), [np.empty(0, np.int64)], 0
        for batch in batches:
            for text in utf8(batch):
                if words := text.split():
                    waiting.append(cells(words, buckets))
                    held += len(waiting[-1])
                if held > 1_000_000:
                    n += np.bincount(np.concatenate(waiting), minlength=buckets)
                    waiting, held = [np.empty(0, np.int64)], 0
        n += np.bincount(np.concatenate(waiting), minlength=buckets)
        at = np.flatnonzero(n)
        yield {"cell": at.astype(np.int32), "n": n[at]}

    return per_task(docs.select("text"), "cell int, n long", count).groupBy("cell").agg(F.sum("n").alias("n"))


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smooth: float = 1.0, sample: int = TRUSTED) -> np.ndarray:
    """log p_target - log p_raw of each cell.  trusted: (doc_id), of which `sample` at most are taken, in hash order;
    their ids, and two numbers a cell, are all that the driver and the broadcast hold."""
    ids = F.broadcast(top_by_hash(trusted.select("doc_id").filter("doc_id is not null").distinct(), sample, "doc_id"))
    logs = []
    for part in (docs.join(ids, "doc_id", "left_semi"), docs):
        n = np.full(buckets, smooth)
        for r in cell_counts(part, buckets).toLocalIterator():
            n[r["cell"]] += r["n"]
        logs.append(np.log(n / n.sum()) if n.sum() > smooth * buckets else None)
    target, raw = logs
    return np.zeros(buckets) if target is None or raw is None else target - raw


def assess(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, sample: int = TRUSTED) -> DataFrame:
    """A row per row of `docs` (doc_id, text): the base counts, base_failed, score and kept."""
    ratio = docs.sparkSession.sparkContext.broadcast(fit_ratio(docs, trusted, buckets, sample=sample))
    classes = _classes()

    def score(batch):
        out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")}
        for text in utf8(batch):
            words = text.split()
            kind = np.bincount(classes[np.frombuffer(text, np.uint8)], minlength=5)
            lines = [x for x in text.split(b"\n") if x.strip()]
            out["n_words"].append(len(words))
            out["word_chars"].append(len(text) - int(kind[_SPACE]) - int(kind[_INNER]))
            out["n_symbols"].append(int(kind[_SYMBOL]))
            out["n_dup_lines"].append(len(lines) - len(set(lines)))
            out["n_repeat_words"].append(repeated_words(hashes(words)) if len(words) > 5 else 0)
            out["score"].append(float(ratio.value[cells(words, buckets)].mean()) if words else 0.0)
        return {"doc_id": batch.column("doc_id"), **out}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), schema, score).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
