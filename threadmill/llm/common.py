"""What the operators of this subpackage share: reading, cutting lineage, word splitting and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

xxh = xxhash.xxh3_64_intdigest
MIX = np.uint64(0x9E3779B97F4A7C15)
ROLL = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as `F.col` takes it, whatever dots and quotes it holds."""
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a private one only where none is named and driver and
    executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="threadmill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: later work starts from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that `cut` wrote, when nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Gives a form of `cut` for frames that are read inside the block only: their folders go at its end, unless kept as
    `lasting` because the result reads them."""
    paths: list[str] = []

    def keep(df: DataFrame, lasting: bool = False) -> DataFrame:
        path = f"{shared_dir(spark)}/threadmill-{uuid.uuid4().hex}"
        if not lasting:
            paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        for path in paths:
            discard(spark, path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most `rows` rows in an Arrow batch of what is run inside the block; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches of whole texts are held several times over, by the executor and its Python workers: keep them small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return to the system what this process has freed: Spark keeps Python workers for later tasks, and what they hold while they wait
    counts on their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc can be asked
        ctypes.CDLL(None).malloc_trim(0)


def per_task(df: DataFrame, schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, object]]]) -> DataFrame:
    """Apply `fn` to the Arrow batches of each task; what it yields are the columns of `schema` in their order."""
    small_batches(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for cols in fn(b for b in batches if b.num_rows):
            made = [x if isinstance(x, pa.Array) else pa.array(x, type=pa.binary()).cast(f.type) if isinstance(x, list) and x and isinstance(x[0], bytes) else pa.array(x, type=f.type) for x, f in zip(cols.values(), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)
            del cols, made  # else they stay while the next are made
        give_back()

    return df.mapInArrow(run, target)


def per_batch(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict[str, object]]) -> DataFrame:
    """Apply `fn` to each Arrow batch of `df`; it returns the columns of `schema` in their order."""
    return per_task(df, schema, lambda batches: map(fn, batches))


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    col = batch.column(name)
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [x or b"" for x in col.to_pylist()]


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh, words), np.uint64, len(words))


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * MIX
        h = (h ^ (h >> np.uint64(29))) * ROLL
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of `k` consecutive values; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = h[:n].copy()
        for i in range(1, k):
            acc = acc * ROLL + h[i : i + n]
    return scramble(acc)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id written in decimal, modulo `m`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m)).cast("int")


def top_by_hash(df: DataFrame, n: int, *key: str) -> DataFrame:
    """At most `n` rows, the first in the order of a hash of `key`: the same rows on every run and however the table is
    split.  Of a large table only the rows whose hash is low enough for twice `n` are sorted."""
    low = F.pmod(F.xxhash64(*key), F.lit(1 << 30))
    total = df.count()
    some = df.filter(low < -(-2 * n * (1 << 30) // total)) if total > 2 * n else df
    return some.orderBy(low, *key).limit(n)


def most_frequent(counts: DataFrame, most: int) -> dict[int, int]:
    """The words (as hashes) of `counts` (word, c) with the highest counts, `most` at most: all that reach the lowest count class (a
    twelfth of a doubling) with which they still fit.  The driver holds a row per class, then those words."""
    kind = F.floor(F.log2("c") * 12)
    classes = sorted(((r["k"], r["n"]) for r in counts.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, least = 0, None
    for k, n in classes:
        held += n
        if held > most:
            break
        least = k
    if least is None:
        return {}
    rows = counts.filter(kind >= least).collect()
    return {r["word"]: r["c"] for r in sorted(rows, key=lambda r: (-r["c"], r["word"]))}


def near_ids(ids: DataFrame, bits: int = 20) -> DataFrame:
    """(bit) of the ids of `ids` (doc_id): a hash into 2**bits values, so it can be broadcast however many ids there are.
    A row whose bit is missing has none of the ids; one whose bit is there may have."""
    return F.broadcast(ids.select(id_bit(F.col("doc_id"), bits).alias("bit")).distinct())


def id_bit(doc_id: Column, bits: int = 20) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << bits)).cast("int")


# ---- words of many texts at once ----
_BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * MIX)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
#: Bytes of text that are split at once.
LOT = 1 << 18
#: Words of so many bytes are hashed by themselves.
LONG = 32
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers of ROLL and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * LOT)
        both = []
        for base in (int(ROLL), pow(int(ROLL), -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size > 2 * LOT:  # one very long word: not kept
            return both[0], both[1]
        _powers[:] = both
    return _powers[0], _powers[1]


def word_hashes(buf: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte behind the last) of all words of the texts that stand one after the other in `buf` and begin at `starts`.  A word is
    a run of bytes other than ASCII white space.  The hash of a word under `LONG` bytes is a polynomial in its bytes (A-Z as a-z if
    `lower`), taken from running sums and mixed, so no word is handled by itself; two such words are told apart but for chance.
    Longer ones, of which a polynomial modulo 2**64 cannot tell all apart, are hashed by themselves."""
    n, table, found = len(buf), _LOWER if lower else _BYTE, []
    at = 0
    while at < n:
        end = min(at + LOT, n)
        while end < n:  # a piece ends at a break, so that no word is cut
            gaps = np.flatnonzero(blank(buf[at:end]))
            text = starts[np.searchsorted(starts, end, "right") - 1]
            back = max(at + int(gaps[-1]) + 1 if len(gaps) else at, int(text))
            if back > at:
                end = back
                break
            end = min(n, at + 2 * (end - at))
        piece = buf[at:end]
        solid = ~blank(piece)
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = starts[np.searchsorted(starts, at, "right") : np.searchsorted(starts, end)] - at
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if len(s):
            up, down = powers(len(piece))
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(table.take(piece) * up[: len(piece)], out=total[1:])
            h = scramble((total.take(e + 1) - total.take(s)) * down.take(s))
            for i in np.flatnonzero(e - s >= LONG - 1).tolist():
                word = piece[s[i] : e[i] + 1].tobytes()
                h[i] = xxh(word.lower() if lower else word, LONG)
            found.append((h, s + at, e + (at + 1)))
        at = end
    if len(found) == 1:
        return found[0]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))


def blank(buf: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return (buf == 32) | (buf - np.uint8(9) <= 4)


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row's begin (one more: the end); null counts as empty."""
    col = batch.column(name)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def lots(batch: pa.RecordBatch, name: str = "text", most: int = LOT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, where each row's begin and the end) of a string column, in lots of about
    `most` bytes or of one row."""
    data, offsets = bytes_of(batch, name)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def sum_cells(df: DataFrame, cells: int, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], parts: int = 16) -> np.ndarray:
    """The sum of the arrays of `cells` counts that `count` makes of each task's batches.  The counts travel in parts, a row
    per task and part, and the driver gets the sums alone."""

    def send(batches):
        n = np.zeros(-(-cells // parts) * parts, np.int64)
        n[:cells] = count(batches)
        if n.any():
            yield {"part": np.arange(parts, dtype=np.int32), "n": [p.tobytes() for p in n.reshape(parts, -1)]}

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), strict=True):
                n = np.frombuffer(n, np.int64)
                total[part] = total[part] + n if part in total else n
        if total:
            yield {"part": np.array(list(total), np.int32), "n": [n.tobytes() for n in total.values()]}

    found = np.zeros((parts, -(-cells // parts)), np.int64)
    for r in per_task(per_task(df, "part int, n binary", send).repartition("part"), "part int, n binary", add).collect():
        found[r["part"]] += np.frombuffer(r["n"], np.int64)
    return found.ravel()[:cells]


def mark_cells(df: DataFrame, cells: int, cells_of: Callable[[pa.RecordBatch], np.ndarray], parts: int = 16) -> np.ndarray:
    """Which of `cells` (a power of two) the rows of `df` fall into, as packed bits."""

    def send(batches):
        bits = np.zeros(cells // 8, np.uint8)
        for batch in batches:
            at = np.unique(cells_of(batch))
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        if bits.any():
            yield {"part": np.arange(parts, dtype=np.int32), "bits": [p.tobytes() for p in bits.reshape(parts, -1)]}

    def join(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                bits = np.frombuffer(bits, np.uint8)
                total[part] = total[part] | bits if part in total else bits
        if total:
            yield {"part": np.array(list(total), np.int32), "bits": [b.tobytes() for b in total.values()]}

    out = np.zeros((parts, cells // 8 // parts), np.uint8)
    for r in per_task(per_task(df, "part int, bits binary", send).repartition("part"), "part int, bits binary", join).collect():
        out[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def marked(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether each of `cells` is marked in the packed `bits`."""
    return (bits.take(cells >> 3) >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


class HashIndex:
    """Where a 64-bit hash stands in `keys` (distinct), or -1: an open table, asked for many hashes at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys, self.mask = keys, np.uint64((1 << bits) - 1)
        self.slot = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            free = self.slot[at] < 0
            place, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slot[place] = left[put]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & int(self.mask)

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        at = (h & self.mask).astype(np.int64)
        got = self.slot.take(at)
        open_ = np.flatnonzero((got >= 0) & (self.keys.take(got) != h))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(self.mask)
            got[open_] = self.slot.take(at[open_])
            open_ = open_[(got[open_] >= 0) & (self.keys.take(got[open_]) != h[open_])]
        return got
