"""Indexes: spaces side by side over the rows of their schemas, with the effects of events.

An indexed row is its id, its kept fields and one raw value per space; the vectors are expressions
over the raw values, so a filter and the few columns that a query reads reach the file scan, and
scores of number, recency and category spaces compile to plain arithmetic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators.spaces import Context, Space
from tesserine.schema import KEY, AnyOf, CreatedAtField, Field, IdField, Predicate, Schema, SchemaError, SchemaReference

#: Column with the id of the document that a chunk is cut from.
ORIGIN = "__origin_id"


@dataclass(frozen=True)
class Effect:
    """Events that satisfy ``when`` move the affected entity's part of ``space`` toward the affecting entity's."""

    space: Space
    affected: object
    affecting: object
    when: Predicate | AnyOf | None = None

    @staticmethod
    def _split(side) -> tuple[SchemaReference, float]:
        return side if isinstance(side, tuple) else (side, 1.0)

    @property
    def affected_reference(self) -> SchemaReference:
        return self._split(self.affected)[0]

    @property
    def affecting_reference(self) -> SchemaReference:
        return self._split(self.affecting)[0]

    @property
    def weight(self) -> float:
        return self._split(self.affecting)[1] / self._split(self.affected)[1]

    def validate(self) -> None:
        for side in (self.affected_reference, self.affecting_reference):
            if not isinstance(side, SchemaReference):
                raise SchemaError("an effect joins two references of one event schema")
        if self.affected_reference.schema is not self.affecting_reference.schema:
            raise SchemaError("an effect joins two references of one event schema")
        for p in self.when.members if self.when is not None else ():
            if p.field.schema is not self.affected_reference.schema:
                raise SchemaError("an effect's condition is on its event schema")


class Index:
    def __init__(self, spaces, fields=None, effects=None, fields_to_exclude=None, temperature: float = 0.5, event_influence: float = 0.5, time_decay_floor: float = 1.0, max_age: timedelta | None = None, max_count: int | None = None):
        self.spaces: list[Space] = list(spaces) if isinstance(spaces, (list, tuple)) else [spaces]
        if not self.spaces or None in self.spaces or len(set(map(id, self.spaces))) < len(self.spaces):
            raise SchemaError("an index needs spaces, each once")
        self.fields: list[Field] = list(fields) if isinstance(fields, (list, tuple)) else [fields] if fields is not None else []
        if any(f is None for f in self.fields):
            raise SchemaError("fields must not be None")
        self.excluded = {(f.schema, f.name) for f in fields_to_exclude or []}
        if any(isinstance(f, (IdField, CreatedAtField)) for f in fields_to_exclude or []):
            raise SchemaError("ids and creation times cannot be excluded")
        self.effects: list[Effect] = list(effects or [])
        for e in self.effects:
            e.validate()
            if not any(e.space is s for s in self.spaces):
                raise SchemaError("an effect is on a space of its index")
        if not 0 <= temperature <= 1 or not 0 <= event_influence <= 1:
            raise SchemaError("temperature and event influence lie between 0 and 1")
        if max_age is not None and not max_age.total_seconds():
            raise SchemaError("max_age must not be 0")
        if max_count is not None and max_count < 0:
            raise SchemaError("max_count must be at least 0")
        self.temperature, self.event_influence, self.time_decay_floor, self.max_age, self.max_count = temperature, event_influence, time_decay_floor, max_age, max_count
        self.schemas: list[Schema] = list(dict.fromkeys(s for sp in self.spaces for s in sp.fields))

    @property
    def scale(self) -> float:
        """What a stored part is multiplied with: 1 / sqrt(spaces), nothing for a single space."""
        return 1 / math.sqrt(len(self.spaces)) if len(self.spaces) > 1 else 1.0

    @property
    def length(self) -> int:
        return sum(s.length for s in self.spaces)

    def position(self, space: Space) -> int:
        for i, s in enumerate(self.spaces):
            if s is space:
                return i
        raise SchemaError(f"{space.name} is not in the index")

    def raw_column(self, space: Space) -> str:
        return f"__raw_{self.position(space)}"

    def kept_fields(self, schema: Schema) -> list[Field]:
        return [f for f in schema.fields.values() if (schema, f.name) not in self.excluded and f.column != "id"]

    def rows(self, schema: Schema, df: DataFrame) -> DataFrame:
        """The indexed rows of one schema from rows in the schema's form (see ``Schema.read``).

        A text that is indexed in chunks adds a row per chunk: its id is the document's with ``#`` and
        the chunk's position (and the space's, where several spaces have chunks), ``ORIGIN`` the
        document's id. Such a row has the chunk's vector, the document's values in the other spaces,
        and no fields.
        """
        raws = []
        for s in self.spaces:
            raw = s.source(schema)
            raws.append((F.lit(None).cast(s.raw_type) if raw is None else raw).alias(self.raw_column(s)))
        kept = [f.column for f in self.kept_fields(schema)]
        key = [KEY] if KEY in df.columns else []
        out = df.select("id", *key, *kept, *raws)
        cut = [s for s in self.spaces if schema in getattr(s, "chunked", {})]
        if not cut:
            return out
        out = out.withColumn(ORIGIN, F.lit(None).cast("string"))
        for s in cut:
            c = s.chunked[schema]
            column, mark = c.field.column, f"#{self.position(s)}." if len(cut) > 1 else "#"
            parts = df.select("*", F.posexplode(c.chunks(F.col(column))).alias("__pos", "__chunk"))
            ids = [F.concat(F.col("id"), F.lit(mark), F.col("__pos").cast("string")).alias("id"), *[F.lit(None).cast("long").alias(k) for k in key]]
            fields = [F.lit(None).cast(df.schema[f].dataType).alias(f) for f in kept]
            values = [(s.raw(F.col("__chunk")) if other is s else raw).alias(self.raw_column(other)) for other, raw in zip(self.spaces, raws)]
            out = out.unionByName(parts.select(*ids, *fields, *values, F.col("id").alias(ORIGIN)))
        return out

    def stored_part(self, space: Space, ctx: Context) -> Column:
        return space.stored(F.col(self.raw_column(space)), self.scale, ctx)

    def with_vectors(self, rows: DataFrame, ctx: Context, name: str = "vector") -> DataFrame:
        """``rows`` with the whole stored vector, the parts in the order of the spaces."""
        return rows.withColumn(name, F.concat(*[self.stored_part(s, ctx) for s in self.spaces]))
