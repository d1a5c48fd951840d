"""User-defined sources and sinks as Spark data sources.

A ``RowSource`` says its schema, cuts itself into parts and reads one part in a task, as Arrow batches. A
``RowSink`` takes the rows of a task and is told which tasks of a micro-batch count. Both are named
by ``module:Class`` and built from options, in the driver and in the tasks alike:

    plugged(spark, "mine:Shelf", [Condition("room", "==", 2)], path="...")

Conditions go to the source as an option: it leaves out what it can, and Spark checks them again. (They are not
left to Spark's own push-down: in 4.1 a DataFrame that is used again keeps what was pushed before.)

``ArrowFiles`` is a source for what pyarrow reads (Parquet, CSV, Feather), wherever its file systems reach:
a part is a file's row group whose bounds let the conditions in.

Defined cases: no parts give no rows; conditions never hold for null, but for ``is null``; a task that
fails hands nothing to the sink's ``commit``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce
from importlib import import_module
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tesserine.schema import SchemaError


@dataclass(frozen=True)
class Condition:
    """A field against a value: ``==``, ``<``, ``<=``, ``>``, ``>=``, ``in``, ``is null`` or ``is not null``."""

    field: str
    op: str
    value: object = None

    def on(self, c):
        """As an expression on a column of Spark or of pyarrow."""
        spark = isinstance(c, Column)
        if self.op in ("is null", "is not null"):
            return (c.isNull() if spark else c.is_null()) if self.op == "is null" else (c.isNotNull() if spark else c.is_valid())
        if self.op == "in":
            return c.isin(list(self.value))
        compare = {"==": "__eq__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
        if self.op not in compare:
            raise SchemaError(f"a plugged source knows no condition {self.op}")
        return getattr(c, compare[self.op])(self.value)


class RowSource(Protocol):
    """Built with the options and the conditions; everything that it holds must be picklable."""

    def schema(self) -> T.StructType: ...

    def parts(self) -> list: ...

    def read(self, part: object) -> Iterator[pa.RecordBatch]: ...


class RowSink(Protocol):
    """Built with the options; ``write`` runs in tasks and returns a note that ``commit`` gets on the driver."""

    def write(self, rows: Iterator) -> object: ...

    def commit(self, notes: list, batch: int) -> None: ...


def _named(options: dict) -> type:
    module, _, name = options.get("class", "").partition(":")
    if not name:
        raise SchemaError("a plugged source is named by its option class, as module:Class")
    return getattr(import_module(module), name)


def _source(options: dict) -> RowSource:
    return _named(options)(dict(options), [Condition(**c) for c in json.loads(options.get("conditions", "[]"))])


class _Part(D.InputPartition):
    def __init__(self, value: object):
        super().__init__(value)


class _Reader(D.DataSourceReader):
    def __init__(self, source: RowSource):
        self.source = source

    def partitions(self) -> list[_Part]:
        return [_Part(p) for p in self.source.parts()] or [_Part(None)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return self.source.read(partition.value) if partition.value is not None else iter([])


class _Note(D.WriterCommitMessage):
    def __init__(self, value: object):
        self.value = value


class _Writer(D.DataSourceStreamWriter):
    def __init__(self, sink: RowSink):
        self.sink = sink

    def write(self, iterator: Iterator) -> _Note:
        return _Note(self.sink.write(iterator))

    def commit(self, messages: list, batchId: int) -> None:
        self.sink.commit([m.value for m in messages if m is not None], batchId)

    def abort(self, messages: list, batchId: int) -> None:
        return None


class Plugged(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "plugged"

    def schema(self) -> T.StructType:
        return _source(self.options).schema()

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(_source(self.options))

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(_named(self.options)(dict(self.options)))


def plugged(spark: SparkSession, source: str, conditions: list[Condition] | None = None, **options: str) -> DataFrame:
    """The rows of a source that satisfy all conditions."""
    spark.dataSource.register(Plugged)
    told = json.dumps([asdict(c) for c in conditions or []])
    df = spark.read.format("plugged").options(**options, conditions=told).option("class", source).load()
    return df.filter(reduce(lambda a, b: a & b, [c.on(F.col(c.field)) for c in conditions])) if conditions else df


class ArrowFiles:
    """What pyarrow reads under ``path``; ``kind`` is the format (Parquet by default)."""

    def __init__(self, options: dict, conditions: list[Condition]):
        self.path, self.kind, self.conditions = options["path"], options.get("kind", "parquet"), conditions

    def _dataset(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.path, format=self.kind)

    def schema(self) -> T.StructType:
        return from_arrow_schema(self._dataset().schema)

    def _where(self):
        import pyarrow.dataset as ds

        return reduce(lambda a, b: a & b, [c.on(ds.field(c.field)) for c in self.conditions]) if self.conditions else None

    def parts(self) -> list[tuple[str, int | None]]:
        where, out = self._where(), []
        for fragment in self._dataset().get_fragments(filter=where):
            if self.kind == "parquet":
                out += [(fragment.path, g.id) for g in (fragment.row_groups if where is None else fragment.subset(where).row_groups)]
            else:
                out.append((fragment.path, None))
        return out

    def read(self, part: tuple[str, int | None]) -> Iterator[pa.RecordBatch]:
        schema = self._dataset().schema.remove_metadata()
        for fragment in self._dataset().get_fragments():
            if fragment.path == part[0]:
                chosen = fragment.subset(row_group_ids=[part[1]]) if part[1] is not None else fragment
                for batch in chosen.to_batches(schema=schema, filter=self._where(), use_threads=False):
                    yield batch.replace_schema_metadata(None)


class JsonFolder:
    """A sink of JSON lines under ``path``: a file per task, and a list of the files of each micro-batch that counts."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def _files(self):
        import pyarrow.fs as fs

        files, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        files.create_dir(path, recursive=True)
        return files, path

    def write(self, rows: Iterator) -> str:
        import uuid

        files, path = self._files()
        name = f"{uuid.uuid4().hex}.json"
        with files.open_output_stream(f"{path}/{name}") as out:
            for row in rows:
                out.write((json.dumps(row.asDict(True), default=str) + "\n").encode())
        return name

    def commit(self, notes: list, batch: int) -> None:
        files, path = self._files()
        with files.open_output_stream(f"{path}/batch-{batch}.list") as out:
            out.write("\n".join(sorted(notes)).encode())
