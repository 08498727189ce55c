"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads each word's bytes forwards and backwards (its state starts afresh at every word), labels every byte
position with a distribution over languages, and a document's prediction pools the log-probabilities of all positions
of the whole text.  It is trained in numpy by backpropagation through time on a bounded sample of labelled documents.
Because a word's labels depend on its bytes alone, they are computed once per batch and kept in a bounded memory.

Defined results: null text, or text without a letter, is `und` with score 0; rows with null lang teach nothing; without
any labelled row all predictions are `und`; repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.llm.common import crc_mod, per_batch, utf8

#: Labelled documents per language, words of each (spread over the whole text), hidden units per direction.
DOCS, WORDS, HIDDEN = 120, 200, 12
#: Bytes of a word that one sequence holds; a longer word is read in pieces of this many.
PIECE = 24
MEMORY = 400_000
#: Words that are labelled at a time.
LOT = 300_000


@dataclass
class Net:
    """Parameters of both directions ([2, ...]) and of the output layer.  Byte value 0 pads."""

    langs: list[str]
    E: np.ndarray  # [2, 256, 3H] input contributions to update, reset, candidate
    U: np.ndarray  # [2, H, 3H]
    V: np.ndarray  # [2H, L]
    c: np.ndarray  # [L]

    def forward(self, x: np.ndarray, keep: bool = False):
        """x: [B, T] bytes. States of both directions per position [B, T, 2H] and what backward() needs."""
        b, t = x.shape
        h = self.U.shape[1]
        out, steps = np.zeros((b, t, 2 * h), np.float32), []
        for d in (0, 1):
            s = np.zeros((b, h), np.float32)
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                col = x[:, i]
                live = (col > 0).astype(np.float32)[:, None]
                a, r_in = self.E[d][col], s @ self.U[d][:, : 2 * h]
                g = 1 / (1 + np.exp(-(a[:, : 2 * h] + r_in)))
                z, r = g[:, :h], g[:, h:]
                n = np.tanh(a[:, 2 * h :] + (r * s) @ self.U[d][:, 2 * h :])
                z = z * live
                new = s + z * (n - s)
                if keep:
                    steps.append((d, i, s, z, r, n, live))
                s = new
                out[:, i, d * h : (d + 1) * h] = s
        return out, steps

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Sum over the positions of each row of the log-probabilities of the languages, [B, L]."""
        s, _ = self.forward(x)
        y = s @ self.V + self.c
        y -= y.max(-1, keepdims=True)
        y -= np.log(np.exp(y).sum(-1, keepdims=True))
        return (y * (x > 0)[:, :, None]).sum(1)


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded byte rows of the words' pieces, the word of each row, and its length."""
    cut = [(i, w[j : j + PIECE]) for i, w in enumerate(words) for j in range(0, len(w), PIECE)]
    flat = np.frombuffer(b"".join(p.ljust(PIECE, b"\0") for _, p in cut), np.uint8).reshape(-1, PIECE)
    return flat, np.array([i for i, _ in cut], np.int64), np.array([len(p) for _, p in cut])


def train(rows: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = 500, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Net:
    """Adam over random batches of (word, language); languages are drawn evenly."""
    langs = sorted({y for _, y in rows})
    rng, h, k = np.random.default_rng(seed), hidden, len(langs)
    x, of, length = pieces([w for w, _ in rows])
    y = np.array([langs.index(rows[i][1]) for i in of])
    net = Net(langs, rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32), rng.normal(0, h**-0.5, (2, h, 3 * h)).astype(np.float32), rng.normal(0, h**-0.5, (2 * h, k)).astype(np.float32), np.zeros(k, np.float32))
    params = [net.E, net.U, net.V, net.c]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by = [np.flatnonzero(y == i) for i in range(k)]
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(rows_of, batch // k + 1) for rows_of in by])
        xb, yb = x[at][:, : length[at].max()], y[at]
        s, kept = net.forward(xb, keep=True)
        live = (xb > 0).astype(np.float32)
        p = np.exp((o := s @ net.V + net.c) - o.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        p[np.arange(len(at))[:, None], np.arange(xb.shape[1])[None], yb[:, None]] -= 1
        p *= live[:, :, None] / live.sum()
        grads = [np.zeros_like(net.E), np.zeros_like(net.U), np.einsum("bth,btl->hl", s, p), p.sum((0, 1))]
        back, carry, last = p @ net.V.T, None, None
        inputs = np.zeros((2, *xb.shape, 3 * h), np.float32)
        for d, i, s0, z, r, n, alive in reversed(kept):
            carry = np.zeros_like(s0) if d != last else carry
            last = d
            ds = back[:, i, d * h : (d + 1) * h] + carry
            dz, dn = ds * (n - s0) * z * (1 - z) * alive, ds * z * (1 - n * n)
            un = net.U[d][:, 2 * h :]
            drs = dn @ un.T
            dr = drs * s0 * r * (1 - r)
            grads[1][d][:, 2 * h :] += (r * s0).T @ dn
            dg = np.concatenate([dz, dr], 1)
            grads[1][d][:, : 2 * h] += s0.T @ dg
            carry = ds * (1 - z) + drs * r + dg @ net.U[d][:, : 2 * h].T
            inputs[d, :, i] = np.concatenate([dg, dn], 1) * alive
        values, at = np.unique(xb, return_inverse=True)
        hot = np.zeros((xb.size, len(values)), np.float32)
        hot[np.arange(xb.size), at.ravel()] = 1
        for d in (0, 1):
            grads[0][d][values] = hot.T @ inputs[d].reshape(xb.size, -1)
        lr = rate * (1 - step / (steps + 1))
        for q, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def sample_words(docs: DataFrame, per_lang: int = DOCS, words: int = WORDS) -> list[tuple[bytes, str]]:
    """(word, lang) from `per_lang` documents of each language at most, the first in hash order; `words` of each, evenly
    spread over the whole text."""
    ids = docs.select("doc_id", "lang").filter("lang is not null and doc_id is not null")
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= per_lang).select("doc_id").distinct()

    def spread(batch):
        split = [t.split() for t in utf8(batch)]
        return {"lang": batch.column("lang"), "words": [w[:: max(1, -(-len(w) // words))] for w in split]}

    picked = per_batch(docs.join(F.broadcast(ids), "doc_id", "left_semi").filter("lang is not null and text is not null").select("lang", "text"), "lang string, words array<binary>", spread)
    return sorted((bytes(w), r["lang"]) for r in picked.toLocalIterator() for w in r["words"])


class Reader:
    """Pools the network's labels over texts; remembers words up to MEMORY."""

    def __init__(self, net: Net):
        self.net, self.seen, self.rows, self.n = net, {}, np.zeros((MEMORY, len(net.langs)), np.float32), 0

    def learn(self, words: list[bytes]) -> None:
        x, of, length = pieces(words)
        got = np.zeros((len(words), len(self.net.langs)), np.float32)
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), 4096):
            at = order[i : i + 4096]
            np.add.at(got, of[at], self.net.log_probs(x[at][:, : length[at].max()]))
        if self.n + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows[: self.n], np.zeros((len(words) + MEMORY // 4, got.shape[1]), np.float32)])
        self.rows[self.n : self.n + len(words)] = got
        self.seen |= {w: self.n + i for i, w in enumerate(words)}
        self.n += len(words)

    def pooled(self, texts: list[list[bytes]]) -> np.ndarray:
        """A row of summed log-probabilities per text (a list of words)."""
        new = sorted(set().union(*texts) - self.seen.keys())
        if self.n + len(new) > MEMORY:
            self.seen, self.n = {}, 0
            new = sorted(set().union(*texts))
        for i in range(0, len(new), 65_536):
            self.learn(new[i : i + 65_536])
        out = np.zeros((len(texts), len(self.net.langs)))
        for i, words in enumerate(texts):
            at = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
            out[i] = self.rows[at].sum(0, dtype=np.float64)
        return out


def parts(texts: list[tuple[int, bytes]], most: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The words of the texts in lots of about `most`; a very long text is spread over several lots."""
    lot: list[tuple[int, list[bytes]]] = []
    held = 0
    for i, text in texts:
        words = text.split()
        for j in range(0, len(words), most):
            lot.append((i, words[j : j + most]))
            held += len(lot[-1][1])
            if held >= most:
                yield lot
                lot, held = [], 0
    if lot:
        yield lot


def identify(docs: DataFrame, teach: DataFrame | None = None, per_lang: int = DOCS) -> DataFrame:
    """lang_pred and score of every row of `docs` (doc_id, text); teach: (doc_id, text, lang), by default `docs` itself."""
    rows = sample_words(docs if teach is None else teach, per_lang)
    net = docs.sparkSession.sparkContext.broadcast(train(rows) if rows else None)

    def predict(batch):
        n, flags = batch.num_rows, batch.column("letters").to_pylist()
        langs, scores = ["und"] * n, [0.0] * n
        if net.value is not None:
            reader = _READERS.get(id(net.value)) or _READERS.setdefault(id(net.value), Reader(net.value))
            texts = [(i, t) for i, t in enumerate(utf8(batch)) if flags[i]]
            total = np.zeros((n, len(net.value.langs)))
            for lot in parts(texts, LOT):
                np.add.at(total, [i for i, _ in lot], reader.pooled([w for _, w in lot]))
            for i, t in texts:
                y = np.exp((total[i] - total[i].max()) / len(t) ** 0.5)
                langs[i], scores[i] = net.value.langs[int(y.argmax())], float(y.max() / y.sum())
        return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores}

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return per_batch(docs.select(F.col("doc_id").cast("long"), "text", letters.alias("letters")), "doc_id long, lang_pred string, score double", predict)


_READERS: dict[int, Reader] = {}


def held_out(docs: DataFrame, m: int = 4, r: int = 2):
    return crc_mod(docs["doc_id"], m) == r
