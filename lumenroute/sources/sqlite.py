"""Reading SQLite catalogues, and Python data sources for listings and cameras.

A table is read in ranges of its row ids, one partition a range, by the SQLite
library that comes with Python; the file must be where all executors see it.
Columns without a declared type, and all but integers and reals, are read as strings.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from . import plugins

BATCH = 10_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    connection = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    connection.text_factory = lambda b: b.decode("utf-8", "replace")
    return connection


def tables(path: str, like: str = "%") -> list[str]:
    """The tables of a file in the order of their names, by an SQL pattern."""
    connection = _open(path)
    try:
        return [r[0] for r in connection.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name LIKE ? ORDER BY name", (like,))]
    finally:
        connection.close()


def _kind(declared: str) -> T.DataType:
    declared = declared.upper()
    if "INT" in declared:
        return T.LongType()
    return T.DoubleType() if any(x in declared for x in ("REAL", "FLOA", "DOUB")) else T.StringType()


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _value(value, kind: T.DataType):
    if value is None or isinstance(kind, T.StringType):
        return None if value is None else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    try:
        return int(value) if isinstance(kind, T.LongType) else float(value)
    except (TypeError, ValueError):
        return None


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, rows: int):
        self.path, self.table, self.schema, self.rows = path, table, schema, rows

    def partitions(self) -> list[InputPartition]:
        connection = _open(self.path)
        try:
            first, last = connection.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        finally:
            connection.close()
        return [_Range(a, min(a + self.rows - 1, last)) for a in range(first, last + 1, self.rows)] if first is not None else [_Range(1, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        kinds = {T.LongType: pa.int64(), T.DoubleType: pa.float64()}
        names = ", ".join(_quoted(f.name) for f in self.schema.fields)
        connection = _open(self.path)
        try:
            cursor = connection.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (partition.first, partition.last))
            while rows := cursor.fetchmany(BATCH):
                columns = [pa.array([_value(r[k], f.dataType) for r in rows], kinds.get(type(f.dataType), pa.string())) for k, f in enumerate(self.schema.fields)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.schema.fields])
        finally:
            connection.close()


class SqliteSource(DataSource):
    """Options: path, dbtable, and rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "lumenroute_sqlite"

    def schema(self) -> T.StructType:
        connection = _open(self.options["path"])
        try:
            found = list(connection.execute(f"PRAGMA table_info({_quoted(self.options['dbtable'])})"))
        finally:
            connection.close()
        if not found:
            raise ValueError(f"no table {self.options['dbtable']!r} in {self.options['path']!r}")
        return T.StructType([T.StructField(c[1], _kind(c[2] or "")) for c in found])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["dbtable"], schema, int(self.options.get("rowsPerPartition", 100_000)))


def table(spark: SparkSession, path: str, name: str, rows: int = 100_000) -> DataFrame:
    """A table of a SQLite file; a missing file or table is an error."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("lumenroute_sqlite").option("path", path).option("dbtable", name).option("rowsPerPartition", rows).load()


class ListingReader(DataSourceReader):
    def __init__(self, function, folder: str, recursive: bool, page: int):
        self.function, self.folder, self.recursive, self.page = function, folder, recursive, page

    def read(self, partition) -> Iterator[tuple]:
        for depth, folder in self._folders():
            token = None
            while True:
                entries, token = self.function(folder, token, self.page)
                for e in entries:
                    if not e.get("folder") and str(e["name"]).lower().endswith((".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff")):
                        yield e["id"], e["name"], e.get("length"), depth
                if token is None:
                    break

    def _folders(self) -> Iterator[tuple[int, str]]:
        yield 0, self.folder
        if self.recursive:  # one level, as a listing goes no deeper
            token = None
            while True:
                entries, token = self.function(self.folder, token, self.page)
                yield from ((1, e["id"]) for e in entries if e.get("folder"))
                if token is None:
                    break


class ListingSource(DataSource):
    """A remote folder's images, by a ``listing`` plug-in: function(folder, page token, page size) -> (entries, next token)."""

    @classmethod
    def name(cls) -> str:
        return "lumenroute_listing"

    def schema(self) -> str:
        return "file_id string, name string, length bigint, depth int"

    def reader(self, schema: T.StructType) -> ListingReader:
        function = plugins.loaded("listing", self.options["plugin"])
        return ListingReader(function, self.options["folder"], self.options.get("recursive", "false").lower() == "true", int(self.options.get("page", 100)))


def listing(spark: SparkSession, plugin: str, folder: str, recursive: bool = False, page: int = 100) -> DataFrame:
    """(file_id, name, length, depth) of a remote folder's images; ``plugin`` is the ``module:function`` that lists."""
    spark.dataSource.register(ListingSource)
    return spark.read.format("lumenroute_listing").option("plugin", plugin).option("folder", folder).option("recursive", str(recursive)).option("page", page).load()


class CameraReader(SimpleDataSourceStreamReader):
    """Frames numbered from 0; a frame that has been read is kept until it is committed, so that it can be read again."""

    def __init__(self, make, options: dict):
        self.make, self.options = make, options
        self.camera, self.kept = None, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.camera is None:
            self.camera = self.make(self.options)
            self.camera.open()
        at = start["frame"]
        frame = self.camera.read()
        if frame is None:
            return iter(()), {"frame": at}
        data, height, width = frame
        self.kept[at] = (at, datetime.now(), data, height, width)
        return iter([self.kept[at]]), {"frame": at + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([self.kept[k] for k in range(start["frame"], end["frame"]) if k in self.kept])

    def commit(self, end: dict) -> None:
        self.kept = {k: v for k, v in self.kept.items() if k >= end["frame"]}


class CameraSource(DataSource):
    """A camera as a stream, by a ``camera`` plug-in: make(options) -> an object with open, read -> (bytes, height, width) or None, and close."""

    @classmethod
    def name(cls) -> str:
        return "lumenroute_camera"

    def schema(self) -> str:
        return "frame bigint, ts timestamp, data binary, height int, width int"

    def simpleStreamReader(self, schema: T.StructType) -> CameraReader:  # noqa: N802
        return CameraReader(plugins.loaded("camera", self.options["plugin"]), dict(self.options))


def camera(spark: SparkSession, plugin: str, **options: str) -> DataFrame:
    """The stream of a camera's frames; ``plugin`` is the ``module:function`` that makes it."""
    spark.dataSource.register(CameraSource)
    reader = spark.readStream.format("lumenroute_camera").option("plugin", plugin)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()
