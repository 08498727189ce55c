"""Byte budgets: prefixes, tails, and the sink's greedy admission."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.functions.text import tail_slice

RESERVE = 256


def fit_prefix(rows: DataFrame, max_bytes: int, length: str, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """Rows while their lengths, and one byte each, fit; the first always does."""
    w = W.partitionBy(key).orderBy(seq)
    used = F.sum(F.col(length) + 1).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"__used": used, "__n": F.row_number().over(w)}).filter((F.col("__used") <= max_bytes) | (F.col("__n") == 1)).drop("__used", "__n")


def tail_budget(rows: DataFrame, budget: int, block: str, separator: int = 1, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """The newest blocks that fit `budget` less the reserve, up to the first that does not: it and all older ones go.
    Empty blocks cost nothing and are skipped.  If the newest itself is too long, its last whole lines stay."""
    room = budget - RESERVE
    kept = rows.filter(F.coalesce(F.col(block), F.lit("")) != "")
    w = W.partitionBy(key).orderBy(F.desc(seq))
    cost = F.octet_length(block) + F.when(F.row_number().over(w) == 1, 0).otherwise(separator)
    used = kept.withColumn("__cost", cost).withColumns({"__used": F.sum("__cost").over(w.rowsBetween(W.unboundedPreceding, 0)), "__n": F.row_number().over(w)})
    fits = F.col("__used") <= room
    cut = F.when(~fits & (F.col("__n") == 1), tail_slice(block, room)).otherwise(F.col(block))
    return used.withColumn(block, cut).filter(fits | ((F.col("__n") == 1) & F.col(block).isNotNull())).drop("__cost", "__used", "__n")


def greedy_admission(rows: DataFrame, max_bytes: int, length: str, head: int = 1, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """(key, seq, admitted) of every record: it is admitted if the bytes so far, a comma, its length and the closing bracket
    fit; a smaller one may be after one that did not.  The outcome depends on the path, so a fold reads each session's
    records in order; its state (bytes and whether any was admitted) is carried from batch to batch, so a session may be
    of any length.  A null length is neither admitted nor refused.

    The records are dealt by a hash of the key: Spark leaves out a repartition by the key itself over rows that are dealt by it, as a
    union is whose sides are, but as the fold requires nothing, it may then read each side's partitions in its own way."""
    read = rows.select(key, F.col(seq).cast("long").alias(seq), F.col(length).cast("long").alias("__len")).repartition(F.xxhash64(key)).sortWithinPartitions(key, seq)
    schema = T.StructType([*read.schema[:2], T.StructField("admitted", T.BooleanType())])

    def fold(batches):
        now, used, some = object(), head, False
        for batch in batches:
            out = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != now:
                    now, used, some = k, head, False
                ok = None if n is None else used + some + n + 1 <= max_bytes
                if ok:
                    used, some = used + some + n, True
                out.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=schema.names)

    return read.mapInArrow(fold, schema)


def capped_text(text: str, max_bytes: int) -> tuple[str, bool]:
    """A finished report cut at the last newline within `max_bytes`, else hard; whole characters only."""
    raw = text.encode()
    if len(raw) <= max_bytes:
        return text, False
    cut = raw[:max_bytes].decode("utf-8", "ignore")
    at = cut.rfind("\n")
    return (cut[: at + 1] if at >= 0 else cut), True
