"""Mixing sources to target weights.

Every source's words, in a fixed document order, are packed into blocks of `block` words.  A mix is a list of slots:
for each output shard a multinomial draw says how many of its slots each source fills, and the j-th slot of a source
takes the block at place j of a keyed permutation of its block numbers (a new permutation each time round).  Slots and
blocks meet in an equi-join on (source, block).

Defined results: null text has size 0; a null source is a source of its own, ordered last; documents of size 0 take 0;
repeated rows are separate documents; an empty table gives an empty mix.  Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadmill.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 100_000
ROWS_PER_BUCKET = 512


@dataclass
class Mix:
    """`docs`: one row per document with its place; `slots`: (shard, slot, src, place, block); `sources`: totals and targets."""

    docs: DataFrame
    slots: DataFrame
    sources: DataFrame
    block: int


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def water_fill(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of sum(sizes) by weight; none above `cap` times its size, what is above goes to the others by weight."""
    total, held = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest, w = total - sum(held.values()), sum(weights[i] for i in free)
        share = {i: rest * weights[i] / w for i in free}
        over = [i for i in free if share[i] > cap * sizes[i]]
        if not over:
            return [held[i] if i in held else share[i] for i in range(len(sizes))]
        held |= {i: cap * sizes[i] for i in over}


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Where a keyed permutation of [0, n) puts i.  A Feistel network over the next power of four; values that fall
    outside [0, n) walk on until they are inside, so it stays a permutation."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.astype(np.uint64), np.ones(len(i), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        with np.errstate(over="ignore"):
            for r in range(rounds):
                f = (right + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ k
                f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Multinomial draws of source counts, a row per shard, with chances in proportion to what each source still has to
    fill; a draw above that is cut and drawn again, so the columns add up to `slots`."""
    rng, left, out = np.random.Generator(np.random.PCG64(seed)), np.array(slots, np.int64), []
    for k in range(shards):
        need, got = int(-(-left.sum() // (shards - k))), np.zeros(len(left), np.int64)
        while need > 0:
            rest = left - got
            draw = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
            got, need = got + draw, need - int(draw.sum())
        left, out = left - got, [*out, got]
    return np.array(out, np.int64).reshape(shards, len(slots))


def mix_sources(docs: DataFrame, weights: list[float] | None = None, cap: float = 3.0, block: int = 256, shards: int = 64, seed: int = 20240607) -> Mix:
    """Plan a mix of all of `docs` (doc_id, text, source).  weights: by source in code point order, repeating (default
    1, 2, 3); cap: how often a source's words may be taken.  The driver holds three numbers per source (at most
    MAX_SOURCES, more raise) and a count per source and shard."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")).withColumn("src", _key(F.col("source")))
    sized = cut(sized)
    found = sized.groupBy("src", "source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"].encode() if r["source"] is not None else b""))
    sizes, weights = [r["n"] for r in found], weights or [1.0, 2.0, 3.0]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap) if sum(sizes) else [0.0] * len(sizes)
    blocks = [-(-n // block) for n in sizes]
    slots = [min(int(cap * b), round(t * b / n)) if n else 0 for n, b, t in zip(sizes, blocks, targets, strict=True)]
    sources = spark.createDataFrame([(r["src"], n, t, b) for r, n, t, b in zip(found, sizes, targets, blocks, strict=True)], "src string, source_size long, target double, n_blocks long")

    runs, at = [], [0] * len(slots)
    for shard, row in enumerate(shard_counts(slots, shards, seed)):
        begun = 0
        for i, n in enumerate(row.tolist()):
            runs += [(found[i]["src"], blocks[i], i + seed, shard, at[i] + j, begun + j, min(65_536, n - j)) for j in range(0, n, 65_536)]
            at[i], begun = at[i] + n, begun + n
    slot = spark.createDataFrame(runs, "src string, n_blocks long, seed long, shard int, first long, begun long, n long").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    place = F.col("first") + F.col("k")

    @F.pandas_udf("long")
    def where(i: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(i.to_numpy(), n.to_numpy(), key.to_numpy()))

    turn = F.floor(place / F.col("n_blocks"))
    slot = slot.select("shard", (F.col("begun") + F.col("k")).alias("slot"), "src", place.alias("place"), where(place % F.col("n_blocks"), "n_blocks", F.xxhash64("seed", turn)).alias("block"))

    n_buckets = max(1, -(-sum(r["rows"] for r in found) // ROWS_PER_BUCKET))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).cast("int"))
    in_bucket = W.partitionBy("src", "bucket").orderBy("doc_id", "size")
    before = sized.groupBy("src", "bucket").agg(F.sum("size").alias("n")).select("src", "bucket", (F.sum("n").over(W.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("before"))
    placed = sized.withColumns({"nth": F.row_number().over(in_bucket), "end": F.sum("size").over(in_bucket.rowsBetween(W.unboundedPreceding, 0))})
    placed = placed.join(before, ["src", "bucket"]).join(F.broadcast(sources), "src")
    start = F.col("before") + F.col("end") - F.col("size")
    return Mix(placed.select("doc_id", "source", "src", "bucket", "nth", "size", "source_size", "target", start.alias("start")), slot, sources, block)


def pieces(mix: Mix) -> DataFrame:
    """A row per document and block of its source that holds words of it: block, first word in the document, words."""
    start, end, size = F.col("start"), F.col("start") + F.col("size"), F.lit(mix.block)
    split = mix.docs.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(start / size), F.floor((end - 1) / size))))
    low = F.greatest(start, F.col("block") * size)
    return split.select("doc_id", "src", "bucket", "nth", "block", (low - start).alias("first_word"), (F.least(end, (F.col("block") + 1) * size) - low).alias("words"))


def taken(mix: Mix) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    drawn = mix.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
    each = pieces(mix).join(drawn, ["src", "block"]).groupBy("src", "bucket", "nth").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return mix.docs.join(each, ["src", "bucket", "nth"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def rendered(mix: Mix, docs: DataFrame) -> DataFrame:
    """The mix itself: shard, slot, source block and, in order, the pieces of text that fill it (doc_id, first_word, words, text)."""
    words = docs.select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("all_words")).dropDuplicates(["doc_id"])
    parts = pieces(mix).join(words, "doc_id").withColumn("text", F.array_join(F.slice("all_words", (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")), " "))
    return mix.slots.join(parts.select("src", "block", "bucket", "nth", "doc_id", "first_word", "words", "text"), ["src", "block"])
