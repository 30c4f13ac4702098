"""SQLite and DuckDB files as a Spark data source, in parallel.

A folder holds one database file per partition of what was written, or any
number of files of one's own; each is read in ranges of row ids. Conditions and
columns are left to the databases. All files are on a path that every executor
sees.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "tidewright_filedb"
#: Rows of a range, and of a batch.
RANGE, BATCH = 500_000, 10_000
_KINDS = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.ByteType: "INTEGER", T.DoubleType: "DOUBLE", T.FloatType: "DOUBLE", T.BooleanType: "BOOLEAN", T.StringType: "VARCHAR", T.BinaryType: "BLOB"}


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str, engine: str):
    if engine == "duckdb":
        import duckdb

        return duckdb.connect(path, read_only=os.path.exists(path))
    return sqlite3.connect(path)


def _kind(declared: str) -> str:
    """The Spark type of a column's declared type."""
    d = declared.upper().split("(")[0].strip()
    if "INT" in d:
        return "long"
    if d in ("DOUBLE", "REAL", "FLOAT", "DECIMAL", "NUMERIC"):
        return "double"
    return "boolean" if d.startswith("BOOL") else "binary" if d == "BLOB" else "string"


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    last: int


class FileDatabase(DataSource):
    """Options: ``path`` (a file or a folder), ``table``, ``engine`` (sqlite or duckdb), ``rows`` of a range, ``where``, and ``columns`` (one a line)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def files(self) -> list[str]:
        path = _local(self.options["path"])
        return sorted(glob.glob(f"{path}/*.db")) if os.path.isdir(path) else [path]

    def schema(self) -> str:
        files, table = self.files(), self.options["table"]
        if not files:
            raise FileNotFoundError(f"no database files in {self.options['path']}")
        con = _open(files[0], self.options.get("engine", "sqlite"))
        try:
            rows = con.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
        finally:
            con.close()
        kinds = {r[1]: _kind(r[2]) for r in rows}
        names = wanted.split("\n") if (wanted := self.options.get("columns")) else list(kinds)
        return ", ".join(f"`{c.replace('`', '``')}` {kinds[c]}" for c in names)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.files(), self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], options, schema: T.StructType):
        self.files, self.table, self.engine, self.schema = files, options["table"], options.get("engine", "sqlite"), schema
        self.range = int(options.get("rows", RANGE))
        self.where = options.get("where")

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids, which are dense in files written once."""
        out: list[InputPartition] = []
        for path in self.files:
            con = _open(path, self.engine)
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            finally:
                con.close()
            if low is not None:
                out += [_Range(path, a, min(a + self.range - 1, high)) for a in range(low, high + 1, self.range)]
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
        where = "rowid BETWEEN ? AND ?" + (f" AND ({self.where})" if self.where else "")
        con = _open(part.path, self.engine)
        try:
            cursor = con.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE {where}", [part.first, part.last])
            while rows := cursor.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array([_value(v, f.type) for v in c], f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
        finally:
            con.close()


def _value(v, kind: pa.DataType):
    """What a database returns as what the column holds: files of SQLite may mix types."""
    if v is None:
        return None
    if pa.types.is_string(kind):
        return v if isinstance(v, str) else str(v)
    if pa.types.is_boolean(kind):
        return bool(v)
    return float(v) if pa.types.is_floating(kind) else v


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileDatabase)


def read(spark: SparkSession, path: str, table: str, engine: str = "sqlite", columns: list[str] | None = None, where: str | None = None, rows: int = RANGE) -> DataFrame:
    """A table of a database file, or of all files in a folder.

    ``columns`` and the SQL condition ``where`` are run by the databases, range by
    range of ``rows`` row ids. They are parameters, as Spark 4.1 lets the filters that
    it pushes into a Python source act on later queries of the same DataFrame too.
    """
    register(spark)
    options = {"path": path, "table": table, "engine": engine, "rows": rows} | ({"where": where} if where else {}) | ({"columns": "\n".join(columns)} if columns else {})
    return spark.read.format(FORMAT).options(**options).load()


def write(df: DataFrame, folder: str, table: str, engine: str = "sqlite") -> int:
    """Each partition as a database file in ``folder``, which has to be new; returns the rows written.

    A file is made under another name and then renamed to the partition's, so a
    repeated task replaces the file and never adds to it. Dates, times and
    decimals are kept as text.
    """
    path = _local(folder)
    os.makedirs(path)
    kinds = [(f.name, _KINDS.get(type(f.dataType), "VARCHAR")) for f in df.schema.fields]
    plain = df.select(*[F.col(f"`{f.name.replace('`', '``')}`").cast("string" if type(f.dataType) not in _KINDS else f.dataType) for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        temporary = f"{path}/.{part:06d}-{uuid.uuid4().hex}"
        con = _open(temporary, engine)
        con.execute(f"CREATE TABLE {_quoted(table)} ({', '.join(f'{_quoted(c)} {k}' for c, k in kinds)})")
        con.execute("BEGIN TRANSACTION")
        put = f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(kinds))})"
        for b in batches:
            con.executemany(put, list(zip(*(c.to_pylist() for c in b.columns), strict=True)))
            n += b.num_rows
        con.commit()
        con.close()
        os.replace(temporary, f"{path}/part-{part:06d}.db")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return plain.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
