"""A read-only Spark data source for SQLite tables: conditions become WHERE clauses, row ranges or lists of values become partitions.

Conditions are an option of the table and not left to filter pushdown: Spark 4.1 keeps the filters pushed into a Python
source with the table, and a second query over the same DataFrame would still see the first one's."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_OPS = ("=", ">", ">=", "<", "<=", "like", "in")
_TYPES = {"INT": "long", "INTEGER": "long", "BIGINT": "long", "REAL": "double", "DOUBLE": "double"}


def connect(path: str) -> sqlite3.Connection:
    """Read-only; a folder means the store's file inside it; a missing file is an error, not an empty store."""
    path = os.path.join(path, "opencode.db") if os.path.isdir(path) else path
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Part(InputPartition):
    """Conditions that pick a part of the table, and their values."""

    def __init__(self, where: list[str], values: list[object]):
        self.where, self.values = where, values


def _flat(values) -> list[object]:
    return [x for v in values for x in (v if isinstance(v, list) else [v])]


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, name: str, partitions: int, where: list[list]):
        self.schema, self.path, self.name, self.parts = schema, path, name, partitions
        if bad := [op for _, op, _ in where if op not in _OPS]:
            raise ValueError(f"unknown operator {bad[0]!r}")
        if bad := [c for c, _, _ in where if c not in schema.names]:
            raise ValueError(f"no column {bad[0]!r}")
        self.where = [(c, op, v) for c, op, v in where]

    def partitions(self):
        """Ranges of row numbers; with a list of values, lists of some of the values each, which the column's index finds."""
        shared = [(f'"{c}" {op} ?', v) for c, op, v in self.where if op != "in"]
        lists = [(c, v) for c, op, v in self.where if op == "in"]
        if lists:
            (c, values), *rest = lists
            shared += [(f'"{k}" IN ({", ".join("?" * len(v))})', x) for k, v in rest for x in [v]]
            step = max(1, -(-len(values) // self.parts))
            return [Part([f'"{c}" IN ({", ".join("?" * len(some))})', *(w for w, _ in shared)], [*some, *_flat(v for _, v in shared)]) for some in (values[i : i + step] for i in range(0, len(values), step))] or [Part(["0"], [])]
        with connect(self.path) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.name}"').fetchone()
        if low is None:
            return [Part(["0"], [])]
        step = -(-(high - low + 1) // self.parts)
        return [Part(["rowid >= ?", "rowid < ?", *(w for w, _ in shared)], [i, min(i + step, high + 1), *_flat(v for _, v in shared)]) for i in range(low, high + 1, step)]

    def statement(self, partition: Part) -> str:
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        return f'SELECT {names} FROM "{self.name}" WHERE {" AND ".join(partition.where)}'

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        kinds = {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64()}
        with connect(self.path) as c:
            rows = c.execute(self.statement(partition), partition.values)
            while chunk := rows.fetchmany(10_000):
                cols = list(zip(*chunk, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(col, kinds.get(f.dataType.simpleString(), pa.string())) for col, f in zip(cols, self.schema.fields, strict=True)], names=names)


class SqliteSource(DataSource):
    """Options: path, table, partitions (4), where (JSON list of [column, operator, value], all of which must hold)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> str:
        with connect(self.options["path"]) as c:
            cols = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not cols:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"{n} {_TYPES.get(t.upper(), 'string')}" for _, n, t, *_ in cols)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options["path"], self.options["table"], int(self.options.get("partitions", 4)), json.loads(self.options.get("where", "[]")))


def sqlite_table(spark: SparkSession, path: str, table: str, where: list[tuple[str, str, object]] = (), partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_ro").option("path", path).option("table", table).option("partitions", partitions).option("where", json.dumps(list(where))).load()


def layout(path: str) -> str:
    """`v2` if both of its tables are there, else `legacy`."""
    with connect(path) as c:
        names = {n for (n,) in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    return "v2" if {"session_v2", "session_message"} <= names else "legacy"
