"""Tables with commits as a data source of Spark: ``spark.read.format("commits")``, batch and stream, read and written.

A part of a read is a file; filters that Arrow understands are pushed to it. A
stream's offset is a version of the table, and what it brings are the folders
added since. Tasks write files, and one commit names them all. Files are read and written
by Arrow, so the table lies on a disk that driver and executors have mounted; ``Table`` reads any
file system that Hadoop knows.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from marlspike.sources.commits import State, link_once, replayed, with_whole

NAME = "commits"


def _local(path: str) -> str:
    """A mounted path without its scheme."""
    return path.removeprefix("file://").rstrip("/") if path.startswith("file://") else path.removeprefix("file:").rstrip("/")


@dataclass
class _Log:
    """Commits of a table on a mounted disk."""

    root: str

    def state(self, version: int | None = None) -> State:
        where = f"{self.root}/_commits"

        def read(n: int) -> str:
            with open(f"{where}/{n:012d}.json", encoding="utf-8") as f:
                return f.read()

        return replayed(os.listdir(where) if os.path.isdir(where) else [], read, State(), version)

    def commit(self, make) -> int:
        while True:
            state = self.state()
            n, text = with_whole(state, make(state))
            if link_once(f"{self.root}/_commits/{n:012d}.json", text):
                return n

    def files(self, folders: Iterable[str]) -> list[str]:
        return [f"{self.root}/{d}/{x}" for d in folders for x in sorted(os.listdir(f"{self.root}/{d}")) if x.endswith(".parquet")]


@dataclass
class _File(InputPartition):
    path: str


def _expression(f: Filter) -> ds.Expression | None:
    """What Arrow makes of a filter of one column, if it can."""
    field = ds.field(*f.attribute)
    if isinstance(f, In):
        return field.isin(list(f.value))
    if isinstance(f, IsNotNull):
        return field.is_valid()
    ways = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
    return getattr(field, ways[type(f)])(f.value) if type(f) in ways else None


def _read(path: str, schema: pa.Schema, wanted: ds.Expression | None) -> Iterator[pa.RecordBatch]:
    for b in ds.dataset(path, schema=schema).to_batches(filter=wanted):
        if b.num_rows:
            yield b


class _Reader(DataSourceReader):
    def __init__(self, log: _Log, schema: StructType, version: int | None):
        self.log, self.schema, self.version, self.pushed = log, to_arrow_schema(schema), version, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            e = _expression(f)
            if e is None:
                yield f
            else:
                self.pushed.append(e)

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.log.files(self.log.state(self.version).folders)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a table without files
            return iter(())
        return _read(partition.path, self.schema, reduce(lambda a, b: a & b, self.pushed) if self.pushed else None)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, log: _Log, schema: StructType):
        self.log, self.schema = log, to_arrow_schema(schema)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": self.log.state().version}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        before = self.log.state(start["version"]).folders if start["version"] >= 0 else {}
        # what a later commit merged is still there under its old name: rows come once
        added = [f for n in range(start["version"] + 1, end["version"] + 1) for f, notes in self.log.state(n).folders.items() if f not in before and not notes.get("merged")]
        return [_File(p) for p in self.log.files(dict.fromkeys(added))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _read(partition.path, self.schema, None)


@dataclass
class _Written(WriterCommitMessage):
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, log: _Log, schema: StructType, overwrite: bool):
        self.log, self.schema, self.overwrite, self.folder = log, to_arrow_schema(schema), overwrite, f"data/{uuid.uuid4().hex}"
        os.makedirs(f"{log.root}/{self.folder}", exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        where, rows, out = f"{self.log.root}/{self.folder}/{uuid.uuid4().hex}", 0, None
        for b in iterator:
            out = out or pq.ParquetWriter(f"{where}.part", self.schema)
            out.write_table(pa.Table.from_batches([b]).cast(self.schema))
            rows += b.num_rows
        if out:
            out.close()
            os.rename(f"{where}.part", f"{where}.parquet")  # what a failed task has begun is no file of the table
            return _Written(rows) if rows else _Written(0)
        return _Written(0)

    def commit(self, messages: list[_Written | None]) -> None:
        self.log.commit(lambda s: {"add": {self.folder: {"rows": sum(m.rows for m in messages if m)}}} | ({"remove": list(s.folders)} if self.overwrite else {}))

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(f"{self.log.root}/{self.folder}", ignore_errors=True)


class CommitsSource(DataSource):
    """Register with ``spark.dataSource.register(CommitsSource)``. Options: ``path``, and ``version`` for an older state."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _log(self) -> _Log:
        return _Log(_local(self.options["path"]))

    def schema(self) -> StructType:
        log = self._log()
        files = log.files(log.state().folders)
        if not files:
            raise ValueError("the table is empty: name its schema")
        return from_arrow_schema(pq.read_schema(files[0]))

    def reader(self, schema: StructType) -> _Reader:
        version = self.options.get("version")
        return _Reader(self._log(), schema, None if version is None else int(version))

    def streamReader(self, schema: StructType) -> _StreamReader:  # noqa: N802
        return _StreamReader(self._log(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self._log(), schema, overwrite)
