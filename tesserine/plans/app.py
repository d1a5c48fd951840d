"""The application: sources fill tables by schema, indexes are views over them, queries run on the views."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators.cells import CellIndex
from tesserine.operators.effects import apply_effects
from tesserine.operators.index import Index
from tesserine.operators.spaces import Context
from tesserine.plans.query import Query, QueryPlan
from tesserine.schema import AT, KEY, Schema, SchemaError, condition, has_fields, with_ids
from tesserine.sources.readers import DataLoaderConfig, from_rows, load
from tesserine.sources.store import merged, write_shared
from tesserine.sources.stored import BucketedRows


#: Batches of a schema that are merged when it is read; beyond them the merged rows are written once.
MOST_BATCHES = 8


class Source:
    """Rows of one schema; ``mapping`` names the columns or dot paths that its fields come from.

    Rows are merged by id. ``unique`` says that a first batch has one row per id already, which
    spares the merge and leaves the scan open to pushed filters. ``order`` names the column that
    says which of two rows with one id is the later.
    """

    def __init__(self, schema: Schema, mapping: dict | None = None, loader: DataLoaderConfig | None = None, unique: bool = False, order: str | None = None):
        self.schema, self.mapping, self.loader, self.unique, self.order, self.app = schema, mapping, loader, unique, order, None

    def put(self, rows) -> None:
        """A DataFrame, a pandas frame, a dictionary or a list of them; merged by id."""
        if self.app is None:
            raise SchemaError("the source is not part of a running app")
        self.app.ingest(self, rows)


InMemorySource = InteractiveSource = DataLoaderSource = Source


@dataclass(frozen=True)
class QueryResult:
    """The rows of a query (lazy) and what it was."""

    frame: DataFrame
    plan: QueryPlan

    @property
    def metadata(self) -> dict:
        return {"schema_name": self.plan.schema.schema_name, "search_vector": self.plan.search_vector.tolist(), "search_params": dict(self.plan.search_params)}

    def to_table(self, format_dates: tuple[str, ...] = ()) -> DataFrame:
        """The rows with ``similarity_score``; given time columns as dates."""
        df = self.frame.withColumnRenamed("score", "similarity_score" if "similarity_score" not in self.frame.columns else "query_similarity_score")
        return df.withColumns({c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss") for c in format_dates}) if format_dates else df

    def to_pandas(self, format_dates: tuple[str, ...] = ()):
        """``to_table`` on the driver."""
        return self.to_table(format_dates).toPandas()

    def to_json(self) -> DataFrame:
        """One JSON text per row; bytes as base64."""
        return self.convert(serializable).select(F.to_json(F.struct("*")).alias("value"))

    def convert(self, converter: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows as a converter makes them, ``serializable`` for one."""
        return self.frame.transform(converter)


def serializable(df: DataFrame) -> DataFrame:
    """Rows of plain values: bytes as base64 text, vectors as lists of floats."""
    cast = {"binary": F.base64, "array<double>": lambda c: c.cast("array<float>")}
    return df.select(*[cast[t](F.col(c)).alias(c) if t in cast else F.col(c) for c, t in df.dtypes])


class App:
    """``App(spark, sources, indexes, now=…)``; ``query`` returns a lazy result.

    ``queue`` is called with the schema's name and each raw dictionary that is put (DataFrames are
    not passed on). ``return_origin_id`` gives chunks their document's id in results. ``buckets`` keeps
    rows in tables with so many buckets by id: a put then writes, and shuffles the new rows alone.
    """

    def __init__(self, spark: SparkSession, sources, indices, now: int | None = None, distinct_events: bool = False, return_origin_id: bool = False, queue: Callable[[str, dict], None] | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.stores: dict[Schema, BucketedRows] = {}
        self.sources = list(sources) if isinstance(sources, (list, tuple)) else [sources]
        self.indices: list[Index] = list(indices) if isinstance(indices, (list, tuple)) else [indices]
        self.now, self.distinct_events, self.return_origin_id, self.queue = now, distinct_events, return_origin_id, queue
        self.batches: dict[Schema, list[DataFrame]] = {}
        self.tables: dict[Schema, DataFrame] = {}
        self.cells: dict[tuple[Index, Schema], CellIndex] = {}
        self.moved: dict[tuple[Index, Schema, int], DataFrame] = {}
        for s in self.sources:
            s.app = self
            if s.loader is not None:
                self.ingest(s, load(spark, s.loader))

    def ingest(self, source: Source, rows) -> None:
        """Add a batch. All batches of a schema are merged in one shuffle; every ``MOST_BATCHES`` the result is written, which cuts its lineage."""
        schema, held = source.schema, self.batches.setdefault(source.schema, [])
        self.cells.clear()  # rows may change cells, also those that events move
        self.moved.clear()
        if isinstance(rows, (dict, list, tuple)):
            rows = [rows] if isinstance(rows, dict) else list(rows)
            for row in rows if self.queue else ():
                self.queue(schema.schema_name, row)
            df = from_rows(self.spark, schema, rows, source.mapping)
        else:
            df = schema.read(rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows), source.mapping, keep_key=source.unique and not held, order=source.order)
        if self.buckets:
            store = self.stores.setdefault(schema, BucketedRows(self.spark, f"rows_{uuid.uuid4().hex}", self.buckets))
            self.tables[schema] = store.update(df.drop(KEY))
            return
        if source.unique and not held:
            held.append(df)
            self.tables[schema] = df.drop(AT)
            return
        held.append(df)
        table = merged([b.drop(KEY) for b in held])
        if len(held) >= MOST_BATCHES:
            table = write_shared(table)
            held[:] = [table]
        self.tables[schema] = table

    def clock(self) -> int:
        import time

        return int(time.time()) if self.now is None else self.now

    def rows(self, index: Index, schema: Schema) -> DataFrame:
        """The indexed rows of a schema, with the effects of all events so far."""
        if schema not in self.tables:
            raise SchemaError(f"nothing was put into {schema.schema_name}")
        rows = index.rows(schema, self.tables[schema])
        if not index.effects:
            return rows
        tables = {s: index.rows(s, df) for s, df in self.tables.items() if not s.is_event}
        events = {s: df for s, df in self.tables.items() if s.is_event}
        if not events:
            return rows
        key = index, schema, self.clock()
        if key not in self.moved:  # events are folded once until more is put in or the clock goes on
            self.moved = {k: v for k, v in self.moved.items() if k[2] == key[2]}
            self.moved[key] = apply_effects(index, schema, rows, tables, events, key[2], self.distinct_events)
        return self.moved[key]

    def deal(self, index: Index, schema: Schema, path: str | None = None, cells: int | None = None) -> CellIndex:
        """Write the indexed rows of a schema in cells; until more is put in, queries with a limit or radius read those they need (results are the same)."""
        self.cells[index, schema] = CellIndex.build(self.rows(index, schema), index, self.clock(), path, cells)
        return self.cells[index, schema]

    def query(self, query: Query, strategy: str = "auto", **params) -> QueryResult:
        index = query.index

        def stored(schema: Schema, entity: str) -> dict:
            found = with_ids(self.rows(index, schema), [entity]).limit(1).collect()
            if not found:
                raise SchemaError(f"{schema.schema_name} has no {entity}")
            return found[0].asDict()

        plan = replace(query.bind(params, stored, self.clock(), strategy), origin_id=self.return_origin_id)
        dealt = self.cells.get((index, query.schema))
        return QueryResult(dealt.frame(plan) if dealt else plan.frame(self.rows(index, query.schema)), plan)

    def vectors(self, index: Index, schema: Schema, ids: list[str] | None = None) -> DataFrame:
        """(id, vector): stored vectors, of given ids or all."""
        rows = self.rows(index, schema)
        if ids is not None:
            rows = with_ids(rows, [str(i) for i in ids])
        return index.with_vectors(rows, Context(self.clock())).select("id", "vector")

    def entities(self, schema: Schema, filters=(), fields=()) -> DataFrame:
        """Stored rows of a schema that satisfy all ``filters`` and have a value in each of ``fields``."""
        rows = self.tables[schema]
        where = condition([[(p, p.value) for p in f.members] for f in filters])
        if where is not None:
            rows = rows.filter(where)
        return rows.filter(has_fields(fields)).drop(KEY)


InMemoryExecutor = InteractiveExecutor = App
