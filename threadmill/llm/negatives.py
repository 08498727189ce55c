"""Hard negatives by a two-dimensional block matrix multiply.

Rows are sharded into blocks and their components into chunks.  A shard of anchors meets a shard of rows of the same chunk in a
join on (row block, chunk), where a task multiplies them into a tile of int64 scores.  Where vectors have several chunks it is a partial
one: these travel in the narrowest integers that hold them and are added up by a shuffle on (anchor block, row block).  The tiles are made
and reduced twice, as all of them are anchors times rows and would fill disks: to the best rows of an anchor's label, which give its
positives, and to the best rows of other labels within each anchor-positive window, which the shards of anchors carry.  What leaves a tile is a few rows per anchor or window; a ranked window merges the tiles.

The anchors are a stated set that is held against all rows, so the work grows with anchors times rows; memory does not: a
task holds two shards, a tile or the partial tiles of one pair of blocks.  A block is a hash of the row's own number, so labels,
ids and vectors that many rows share do not gather anywhere.

Nulls: rows with a null label, a null vector or a null or non-finite component take no part.  A null id is no anchor, differs
from every id, and comes last among ties.  Ties by id go on by the row's number.  Repeated rows: every row stands for itself, but a row with
the anchor's own id is not its positive.  Vectors of other widths count as filled up with zeros.  Components beyond 64 bits are
held at the largest long; scores beyond 64 bits wrap around.  An empty table, or one without anchors, gives an empty result.
Further columns, whatever their names, are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import arrow_batches, per_task, workspace

#: Rows of a block, anchors of a block, components of a chunk.
ROWS, ANCHORS, CHUNK = 2048, 256, 256
NULL = np.iinfo(np.int64).max
META = "a_uid binary, a_id binary, a_label binary, c_uid binary, c_id binary, c_label binary"
#: The windows of a block of anchors: anchors, positives, their ids and scores.
WINDOWS = ("w_a_uid", "w_p_uid", "w_p_id", "w_score")
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as long; null if one is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def packed(x: np.ndarray) -> tuple[bytes, str]:
    """An int64 array in the narrowest integers that hold it, and their kind."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return x.astype(kind).tobytes(), kind


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact modulo 2**64; in floats where every sum stays below 2**53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a @ b.T


def shards(rows: DataFrame, blocks: int, chunk: int) -> DataFrame:
    """(block, k, n, width, uid, id, label, kind, part): the chunk `k` of the components of a block's rows in the order of
    their ids, with their numbers, ids and labels in chunk 0."""

    def pack(group: pa.Table) -> pa.Table:
        uid, label = (group.column(c).to_numpy().astype(np.int64) for c in ("uid", "label"))
        ids = group.column("id").fill_null(NULL).to_numpy().astype(np.int64)
        order = np.lexsort((uid, ids))
        vectors = group.column("q").combine_chunks()
        sizes, flat = vectors.value_lengths().to_numpy().astype(np.int64), vectors.flatten().to_numpy()
        dense = np.zeros((len(order), max(1, int(sizes.max()))), np.int64)
        dense[np.repeat(np.arange(len(order)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        dense, block, made = dense[order], group.column("block")[0].as_py(), []
        for k, low in enumerate(range(0, dense.shape[1], chunk)):
            part, kind = packed(dense[:, low : low + chunk])
            head = [x[order].tobytes() if k == 0 else None for x in (uid, ids, label)]
            made.append((block, k, len(order), min(chunk, dense.shape[1] - low), *head, kind, part))
        cols = [pa.array(x, type=t) for x, t in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary()), strict=True)]
        return pa.table(cols, names=["block", "k", "n", "width", "uid", "id", "label", "kind", "part"])

    dealt = rows.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), "uid", "id", "label", "q")
    return dealt.groupBy("block").applyInArrow(pack, "block int, k int, n int, width int, uid binary, id binary, label binary, kind string, part binary")


def tiles(anchors: DataFrame, rows: DataFrame, blocks: int, whole: bool) -> DataFrame:
    """(i, j, kind, tile) and the numbers, ids and labels of both sides: the scores of anchor block i with row block j, and the windows that
    the anchors carry, if any.  whole: the vectors are of one chunk, so a product is a whole tile.

    The shards of anchors are repeated for each block of rows, so they grow with the product of both: they are shuffled, as a broadcast,
    which goes by the size before they are repeated, would gather them in the driver."""
    windows = [c for c in WINDOWS if c in anchors.columns]
    a = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"), F.col("block").alias("i"), "k", *(F.col(c).alias(f"a_{c}") for c in ("n", "width", "uid", "id", "label", "kind", "part")), *windows)
    c = rows.select(F.col("block").alias("j"), "k", *(F.col(c).alias(f"c_{c}") for c in ("n", "width", "uid", "id", "label", "kind", "part")))

    def multiply(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, c = (np.frombuffer(r[f"{x}_part"], r[f"{x}_kind"]).reshape(r[f"{x}_n"], r[f"{x}_width"]).astype(np.int64) for x in "ac")
                w = min(a.shape[1], c.shape[1])
                tile, kind = packed(product(a[:, :w], c[:, :w]))
                meta = {m: [r[m]] for m in ("a_uid", "a_id", "a_label", "c_uid", "c_id", "c_label", *windows)}
                yield {"i": [r["i"]], "j": [r["j"]], "kind": [kind], "tile": [tile], **meta}

    schema = ", ".join([f"i int, j int, kind string, tile binary, {META}", *(f"{w} array<long>" for w in windows)])
    partial = per_task(a.hint("merge").join(c, ["j", "k"]), schema, multiply)
    if whole:
        return partial

    def add(group: pa.Table) -> pa.Table:
        total, head = None, None
        for r in group.to_pylist():
            part = np.frombuffer(r["tile"], r["kind"])
            with np.errstate(over="ignore"):
                total = part.astype(np.int64) if total is None else total + part
            head = r if r["a_uid"] is not None else head
        head["tile"], head["kind"] = packed(total)
        return pa.Table.from_pylist([head], schema=group.schema)

    return partial.groupBy("i", "j").applyInArrow(add, schema)


def _unpacked(r: dict) -> tuple[np.ndarray, ...]:
    a_uid, a_id, a_label, c_uid, c_id, c_label = (np.frombuffer(r[m], np.int64) for m in ("a_uid", "a_id", "a_label", "c_uid", "c_id", "c_label"))
    return np.frombuffer(r["tile"], r["kind"]).reshape(len(a_uid), len(c_uid)).astype(np.int64), a_uid, a_id, a_label, c_uid, c_id, c_label


def _best_first(scores: np.ndarray) -> np.ndarray:
    """The order of each row's scores, highest first; equal ones stay in their order."""
    return np.argsort(~scores, axis=1, kind="stable")


def best_positives(whole: DataFrame, most: int) -> DataFrame:
    """(i, a_uid, p_uid, p_id, score): the first `most` other rows of each anchor's label."""

    def reduce(batches):
        for batch in batches:
            for r in batch.to_pylist():
                scores, a_uid, a_id, a_label, c_uid, c_id, c_label = _unpacked(r)
                found, order = [], _best_first(scores)
                for n in range(len(a_uid)):
                    at = order[n]
                    at = at[(c_label[at] == a_label[n]) & (c_id[at] != a_id[n])][:most]
                    found.append((np.full(len(at), a_uid[n]), c_uid[at], c_id[at], scores[n, at]))
                cols = [np.concatenate(x) for x in zip(*found, strict=True)]
                if len(cols[0]):
                    yield {"i": np.full(len(cols[0]), r["i"], np.int32), **dict(zip(("a_uid", "p_uid", "p_id", "score"), cols, strict=True))}

    found = per_task(whole, "i int, a_uid long, p_uid long, p_id long, score long", reduce)
    first = F.row_number().over(Window.partitionBy("a_uid").orderBy(F.desc("score"), "p_id", "p_uid"))
    return found.withColumn("nth", first).filter(F.col("nth") <= most)


def with_windows(anchors: DataFrame, positives: DataFrame) -> DataFrame:
    """Shards of anchors whose first chunk carries the windows of its block."""
    names = ("a_uid", "p_uid", "p_id", "score")
    windows = positives.groupBy("i").agg(F.collect_list(F.struct(*names)).alias("w"))
    windows = windows.select(F.col("i").alias("block"), F.lit(0).alias("k"), *(F.col("w")[c].alias(f"w_{c}") for c in names))
    return anchors.join(windows.hint("merge"), ["block", "k"], "left")


def best_negatives(whole: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """(a_uid, a_id, p_uid, p_id, p_score, n_uid, n_id, n_score): of each tile the first `most` rows of another label in each
    anchor-positive window that it carries, low % to high % of the positive's score."""

    def reduce(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["w_a_uid"] is None:
                    continue
                scores, a_uid, a_id, a_label, c_uid, c_id, c_label = _unpacked(r)
                order, row = _best_first(scores), {u: n for n, u in enumerate(a_uid.tolist())}
                found, now = [], None
                for u, p_uid, p_id, p in sorted(zip(*(r[w] for w in WINDOWS), strict=True)):
                    if u != now:
                        now, n = u, row[u]
                        at = order[n][c_label[order[n]] != a_label[n]]
                        falling = ~scores[n, at]
                    ceiling = max(-NULL, min(NULL, high * p // 100))
                    begin = int(np.searchsorted(falling, ~ceiling))
                    some = [x for x in at[begin : begin + most].tolist() if low * p <= 100 * int(scores[n, x])]
                    found += [(u, a_id[n], p_uid, p_id, p, c_uid[x], c_id[x], scores[n, x]) for x in some]
                if found:
                    names = ("a_uid", "a_id", "p_uid", "p_id", "p_score", "n_uid", "n_id", "n_score")
                    yield {m: np.array(x, np.int64) for m, x in zip(names, zip(*found, strict=True), strict=True)}

    return per_task(whole, "a_uid long, a_id long, p_uid long, p_id long, p_score long, n_uid long, n_id long, n_score long", reduce)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = ROWS, anchors: int = ANCHORS, chunk: int = CHUNK) -> DataFrame:
    """For each anchor of `rows` (id long, label long, q array of long) and each of its first `positives` other rows of its label,
    the first `negatives` rows of another label whose score is low % to high % of the positive's: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.  A score is the inner product with the anchor."""
    spark = rows.sparkSession
    taken = rows.filter("label is not null and q is not null")
    # a task gets shards, tiles or windows in batches of a few rows, as each may be megabytes
    with workspace(spark) as keep, arrow_batches(spark, 16):
        own = keep(taken.select("id", F.col("label").cast("long").alias("label"), "q", F.coalesce(is_anchor & F.col("id").isNotNull(), F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("uid")))
        n, a = own.agg(F.count("*"), F.count_if("anchor")).first()
        if not a:
            return spark.createDataFrame([], RESULT)
        blocks = -(-n // block)
        asked, every = keep(shards(own.filter("anchor"), -(-a // anchors), chunk)), keep(shards(own, blocks, chunk))
        one = every.filter("k > 0").isEmpty()
        chosen = keep(best_positives(tiles(asked, every, blocks, one), positives))
        mined = keep(best_negatives(tiles(with_windows(asked, chosen), every, blocks, one), negatives, low, high), lasting=True)
    rank = F.row_number().over(Window.partitionBy("a_uid", "p_uid").orderBy(F.desc("n_score"), "n_id", "n_uid"))
    known = lambda c: F.when(F.col(c) != int(NULL), F.col(c))
    best = mined.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return best.select(F.col("a_id").alias("anchor_id"), known("p_id").alias("positive_id"), "rank", known("n_id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score"))
