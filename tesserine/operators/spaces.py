"""Spaces: how a field becomes a vector of known geometry, at rest and in a query.

A space works on a *raw* value per row (a number, a time, category marks, a vector). ``stored``
gives the vector that lies in the index, as a column expression; ``query`` gives the vector of a
query from its weighted inputs, on the driver. Dimensions that carry a negative filter are never
scaled, neither by norms nor by weights; a weight of 0 zeroes them too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta
from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserine.functions import vectors as V
from tesserine.functions.text import HashedEmbedder, TextEmbedder, chunk_column
from tesserine.schema import Blob, DescribedBlob, Field, Float, FloatList, Integer, Schema, SchemaError, String, StringList, Timestamp

DAY = 86_400


class Mode(Enum):
    MAXIMUM = "maximum"
    MINIMUM = "minimum"
    SIMILAR = "similar"


class InputAggregation(Enum):
    AVERAGE = "avg"
    MINIMUM = "min"
    MAXIMUM = "max"


@dataclass(frozen=True)
class LinearScale:
    def value(self, x: float) -> float:
        return x

    def column(self, c: Column) -> Column:
        return c

    def inverse(self, x: float) -> float:
        return x


@dataclass(frozen=True)
class LogarithmicScale:
    base: float = 10.0

    def __post_init__(self):
        if self.base <= 1:
            raise SchemaError("a logarithm needs a base above 1")

    def value(self, x: float) -> float:
        return math.log(1 + x) / math.log(self.base)

    def column(self, c: Column) -> Column:
        return F.log10(1 + c) if self.base == 10 else F.log(1 + c) / math.log(self.base)

    def inverse(self, x: float) -> float:
        return self.base**x - 1


@dataclass(frozen=True)
class PeriodTime:
    period_time: timedelta
    weight: float = 1.0

    def __post_init__(self):
        if self.period_time.total_seconds() <= 0:
            raise SchemaError("a period must be longer than nothing")


def combine(values: Sequence[float], weights: Sequence[float], how: InputAggregation) -> float:
    """Weighted average, or the least or greatest; inputs of weight 0 don't count."""
    have = [(v, w) for v, w in zip(values, weights) if w]
    if how is InputAggregation.AVERAGE:
        return sum(v * w for v, w in have) / sum(w for _, w in have)
    return (min if how is InputAggregation.MINIMUM else max)(v for v, _ in have)


@dataclass(frozen=True)
class Context:
    """What an evaluation depends on besides its data."""

    now: int = 0


class Space:
    """One field per schema, one geometry."""

    length: int
    accepts: tuple[type, ...] = ()
    scalar = False  # raw values are numbers that are averaged before they are embedded
    similar_allowed = True
    aggregation = InputAggregation.AVERAGE

    def __init__(self, fields, salt: str | None = None):
        fields = fields if isinstance(fields, (list, tuple)) else [fields]
        if not fields or any(f is None for f in fields):
            raise SchemaError("a space needs fields")
        self.fields: dict[Schema, Field] = {}
        for f in fields:
            owner = f.blob.schema if isinstance(f, DescribedBlob) else f.schema
            if owner in self.fields:
                raise SchemaError(f"{owner.schema_name} has two fields in one space")
            if not isinstance(f, self.accepts):
                raise SchemaError(f"{type(self).__name__} cannot take a {type(f).__name__}")
            self.fields[owner] = f
        self.salt = salt

    @property
    def name(self) -> str:
        f = next(iter(self.fields.values()))
        of = "+".join(x.name for x in (f.blob, f.text)) if isinstance(f, DescribedBlob) else f.name
        return f"{type(self).__name__}({of}{f', {self.salt}' if self.salt else ''})"

    def source(self, schema: Schema) -> Column | None:
        """The raw value of a row of ``schema``; None where the schema has no field here (events alone fill it)."""
        f = self.fields.get(schema)
        return None if f is None else self.raw(F.col(f.column))

    def raw(self, c: Column) -> Column:
        raise NotImplementedError

    @property
    def raw_type(self) -> str:
        return "double" if self.scalar else "array<double>"

    def normal(self, raw: Column) -> Column:
        """A raw value after events were mixed in, brought back to the space's norm."""
        return raw

    def stored(self, raw: Column, scale: float, ctx: Context) -> Column:
        raise NotImplementedError

    def score(self, raw: Column, q: np.ndarray, scale: float, ctx: Context, strategy: str = "auto") -> Column:
        """Inner product of the stored vector with a query part."""
        return V.dot(self.stored(raw, scale, ctx), q, strategy) if np.any(q) else F.lit(0.0)

    def query(self, inputs: list[tuple[object, float]], items: list[tuple[object, float]], ctx: Context) -> np.ndarray:
        """From ``inputs`` (value, weight) and raw values of stored ``items`` (raw, weight)."""
        raise NotImplementedError

    def masked(self) -> np.ndarray:
        """Dimensions of a query part that no norm or weight scales."""
        return np.zeros(self.length, bool)


class NumberSpace(Space):
    """Three dimensions: a quarter circle over the range, and the filter for values beyond it."""

    length, accepts, scalar = 3, (Integer, Float), True

    def __init__(self, number, min_value: float, max_value: float, mode: Mode, scale=LinearScale(), aggregation_mode: InputAggregation = InputAggregation.AVERAGE, negative_filter: float = 0.0, salt: str | None = None):
        super().__init__(number, salt)
        if min_value >= max_value:
            raise SchemaError("the least value must be under the greatest")
        if negative_filter > 0:
            raise SchemaError("a negative filter must not be above 0")
        if isinstance(scale, LogarithmicScale) and min_value < 0:
            raise SchemaError("a logarithmic scale needs bounds of at least 0")
        self.lo, self.hi, self.mode, self.scale, self.aggregation, self.negative = min_value, max_value, mode, scale, aggregation_mode, negative_filter

    @property
    def similar_allowed(self) -> bool:
        return self.mode is Mode.SIMILAR

    def raw(self, c: Column) -> Column:
        return c.cast("double")

    def _outside(self, raw: Column) -> Column:
        below, above = raw < self.lo, raw > self.hi
        return {Mode.MAXIMUM: below, Mode.MINIMUM: above, Mode.SIMILAR: below | above}[self.mode]

    def _angle(self, raw: Column) -> Column:
        lo, hi = self.scale.value(self.lo), self.scale.value(self.hi)
        inside = F.least(F.greatest(raw, F.lit(float(self.lo))), F.lit(float(self.hi)))
        return (self.scale.column(inside) - lo) / (hi - lo) * (math.pi / 2)

    def stored(self, raw: Column, scale: float, ctx: Context) -> Column:
        angle, out = self._angle(raw), F.coalesce(self._outside(raw), F.lit(True))
        on = lambda x: F.when(out, 0.0).otherwise(x * scale)
        z = F.when(raw.isNotNull() & out, float(self.negative)).otherwise(0.0)
        return F.array(on(F.sin(angle)), on(F.cos(angle)), z)

    def _embed(self, x: float) -> np.ndarray:
        if {Mode.MAXIMUM: x < self.lo, Mode.MINIMUM: x > self.hi, Mode.SIMILAR: not self.lo <= x <= self.hi}[self.mode]:
            return np.array([0.0, 0.0, self.negative])
        lo, hi = self.scale.value(self.lo), self.scale.value(self.hi)
        t = (self.scale.value(min(max(x, self.lo), self.hi)) - lo) / (hi - lo) * math.pi / 2
        return np.array([math.sin(t), math.cos(t), 0.0])

    def _seen(self, raw: float | None) -> float:
        """A stored value as a query sees it: bounded, and just beyond the range where it is outside or missing."""
        step = (self.hi - self.lo) / 1000
        beyond = self.lo - step if self.mode is Mode.MAXIMUM else self.hi + step
        if raw is None or not np.any(self._embed(raw)[:2]):
            return beyond
        return round(min(max(raw, self.lo), self.hi), 10)

    def query(self, inputs, items, ctx):
        if self.mode is not Mode.SIMILAR:
            if len(items) + len(inputs) > 1:
                raise SchemaError("a minimum or maximum takes one input at most")
            if items and not items[0][1]:
                return np.zeros(3)
            return np.array([1.0, 0.0, 1.0] if self.mode is Mode.MAXIMUM else [0.0, 1.0, 1.0])
        have = [(float(v), w) for v, w in inputs if w] + [(self._seen(v), w) for v, w in items if w]
        if not have:
            return np.zeros(3)
        q = self._embed(combine(*zip(*have), self.aggregation))
        q[2] = 0.0
        return q

    def masked(self):
        return np.array([False, False, True])


class RecencySpace(Space):
    """Per period a quarter circle from its start to the end of the current day, and the filter for what is older than all."""

    accepts, scalar, similar_allowed = (Timestamp,), True, False

    def __init__(self, timestamp, time_period_hour_offset: timedelta = timedelta(0), period_time_list=None, aggregation_mode: InputAggregation = InputAggregation.AVERAGE, negative_filter: float = 0.0, salt: str | None = None):
        super().__init__(timestamp, salt)
        periods = period_time_list or [PeriodTime(timedelta(days=14))]
        periods = periods if isinstance(periods, (list, tuple)) else [periods]
        if time_period_hour_offset >= timedelta(hours=24):
            raise SchemaError("the offset must be under a day")
        if negative_filter > 0:
            raise SchemaError("a negative filter must not be above 0")
        self.periods = sorted(periods, key=lambda p: p.period_time)
        self.offset, self.aggregation, self.negative = int(time_period_hour_offset.total_seconds()), aggregation_mode, negative_filter
        self.length = 2 * len(self.periods) + 1
        self.norm = math.sqrt(sum(p.weight**2 for p in self.periods)) or 1.0

    def raw(self, c: Column) -> Column:
        return c.cast("double")

    def _bounds(self, ctx: Context) -> tuple[list[float], float]:
        expiry = ctx.now - ctx.now % DAY + DAY
        return [expiry - p.period_time.total_seconds() + self.offset for p in self.periods], expiry + self.offset

    def stored(self, raw: Column, scale: float, ctx: Context) -> Column:
        starts, end = self._bounds(ctx)
        dims = []
        for p, start in zip(self.periods, starts):
            t = (raw - start) / (end - start) * (math.pi / 2)
            inside = F.coalesce((raw >= start) & (raw <= end), F.lit(False))
            dims += [F.when(inside, f(t) * (p.weight / self.norm * scale)).otherwise(0.0) for f in (F.cos, F.sin)]
        known = raw.isNotNull() & ~((raw >= starts[-1]) & (raw <= end))
        return F.array(*dims, F.when(known, float(self.negative)).otherwise(0.0))

    def query(self, inputs, items, ctx):
        starts, end = self._bounds(ctx)
        seen = lambda t: starts[-1] - 1 if t is None or not starts[-1] <= t <= end else float(t)
        have = [(float(ctx.now), 1.0)] + [(seen(t), w) for t, w in items if w]
        now, out = combine(*zip(*have), self.aggregation), []
        for p, start in zip(self.periods, starts):
            t = (now - start) / (end - start) * math.pi / 2
            out += [math.cos(t) * p.weight, math.sin(t) * p.weight] if start <= now <= end else [0.0, 0.0]
        return np.array([x / self.norm for x in out] + [1.0])

    def masked(self):
        return np.array([False] * (self.length - 1) + [True])


class CategoricalSimilaritySpace(Space):
    """One dimension per category and one for all others."""

    accepts = (String, StringList)

    def __init__(self, category_input, categories: list[str], negative_filter: float = 0.0, uncategorized_as_category: bool = True, salt: str | None = None):
        super().__init__(category_input, salt)
        if negative_filter > 0:
            raise SchemaError("a negative filter must not be above 0")
        self.categories, self.negative, self.others = list(dict.fromkeys(categories)), negative_filter, uncategorized_as_category
        self.length, self.root = len(self.categories) + 1, math.sqrt(len(self.categories))

    def source(self, schema: Schema) -> Column | None:
        f = self.fields.get(schema)
        if f is None:
            return None
        c = F.col(f.column)
        return self.raw(c if isinstance(f, StringList) else F.when(c.isNull(), None).otherwise(F.array(c)))

    def raw(self, c: Column) -> Column:
        """Marks of the categories that a row has; null where it has none."""
        known = F.array(*map(F.lit, self.categories)).cast("array<string>")
        marks = [F.array_contains(c, F.lit(k)).cast("double") for k in self.categories]
        other = (F.size(F.array_except(c, known)) > 0).cast("double") if self.others else F.lit(0.0)
        return F.when(F.size(c) > 0, F.array(*[F.coalesce(m, F.lit(0.0)) for m in marks], F.coalesce(other, F.lit(0.0))))

    def stored(self, raw: Column, scale: float, ctx: Context) -> Column:
        """Marks over the root of their number, at any strength that events left; the filter where there is none."""
        at = lambda i: F.get(raw, F.lit(i))
        return F.array(*[F.when(raw.isNull(), 0.0).when(at(i) != 0, at(i) * (scale / self.root)).otherwise(float(self.negative)) for i in range(self.length)])

    def normal(self, raw: Column) -> Column:
        top = F.array_max(raw)
        return F.when(top > 0, V.scaled(raw, 1 / top)).otherwise(raw)

    def query(self, inputs, items, ctx):
        marks = np.zeros(self.length)
        for value, weight in inputs:
            for c in [value] if isinstance(value, str) else value:
                if c in self.categories:
                    marks[self.categories.index(c)] += self.root * weight
                elif self.others:
                    marks[-1] += self.root * weight
        missing = sum(w * self.root for v, w in inputs for c in ([v] if isinstance(v, str) else v) if c not in self.categories) if not self.others else 0.0
        for raw, weight in items:
            if raw is not None:
                marks += np.asarray(raw, float) / self.root * weight
        total = marks[marks > 0].sum() + max(0.0, missing)
        return marks * (self.root / total) if total > 0 else marks

    def labels(self, raw: Column) -> Column:
        """The categories that a row has; what lies outside all of them is the longest category with ``_`` behind it."""
        names = [*self.categories, f"{max(self.categories, key=lambda c: len(c), default='')}_"]
        marks = F.array(*[F.when(F.get(raw, F.lit(i)) != 0, F.lit(n)) for i, n in enumerate(names)])
        return F.when(raw.isNotNull(), F.array_compact(marks))


class VectorSpace(Space):
    """Unit vectors; inputs of a query are summed with their weights and brought to unit length."""

    def stored(self, raw: Column, scale: float, ctx: Context) -> Column:
        return F.coalesce(V.scaled(raw, scale), F.array_repeat(F.lit(0.0), self.length))

    def score(self, raw, q, scale, ctx, strategy="auto"):
        return V.dot(raw, q * scale, strategy) if np.any(q) else F.lit(0.0)

    def normal(self, raw: Column) -> Column:
        return V.unit(raw, self.length)

    def _input(self, value) -> np.ndarray:
        raise NotImplementedError

    def query(self, inputs, items, ctx):
        have = [(self._input(value), weight) for value, weight in inputs] + [(np.asarray(raw, float), weight) for raw, weight in items if raw is not None]
        return V.l2(V.weighted_sum(have)[0]) if have else np.zeros(self.length)


class CustomSpace(VectorSpace):
    """Vectors that the user brings."""

    accepts = (FloatList,)

    def __init__(self, vector, length: int, salt: str | None = None):
        super().__init__(vector, salt)
        self.length = length

    def raw(self, c: Column) -> Column:
        wrong = F.raise_error(F.lit(f"{self.name} takes vectors of length {self.length}")).cast("array<double>")
        return F.when(c.isNull() | (F.size(c) == self.length), V.unit(c, self.length)).otherwise(wrong)

    def _input(self, value):
        if len(value) != self.length:
            raise SchemaError(f"{self.name} takes vectors of length {self.length}")
        return V.l2(np.asarray(value, float))


@dataclass(frozen=True, eq=False)
class Chunk:
    """A text field that is indexed whole and in chunks (see ``chunk``)."""

    field: String
    options: tuple

    def chunks(self, text: Column) -> Column:
        return chunk_column(text, **dict(self.options))


def chunk(text: String, chunk_size: int = 250, chunk_overlap: int = 20, split_chars_keep: list[str] | None = None, split_chars_remove: list[str] | None = None) -> Chunk:
    """``TextSimilaritySpace(chunk(doc.body))``: every chunk becomes a row of the index beside its document."""
    if not isinstance(text, String):
        raise SchemaError("only a text field has chunks")
    if chunk_size <= 0 or not 0 <= chunk_overlap <= chunk_size:
        raise SchemaError("a chunk has a size above 0 and an overlap of at most that")
    return Chunk(text, (("size", chunk_size), ("overlap", chunk_overlap), ("kept", split_chars_keep), ("removed", split_chars_remove)))


class TextSimilaritySpace(VectorSpace):
    """Embedded texts; the embedder is a plug-in and needs no model by default."""

    accepts = (String,)

    def __init__(self, text, embedder: TextEmbedder | None = None, salt: str | None = None):
        given = text if isinstance(text, (list, tuple)) else [text]
        self.chunked = {c.field.schema: c for c in given if isinstance(c, Chunk)}
        super().__init__([c.field if isinstance(c, Chunk) else c for c in given], salt)
        self.embedder = embedder or HashedEmbedder()
        self.length = self.embedder.length

    def raw(self, c: Column) -> Column:
        return self.embedder.column(c)

    def _input(self, value):
        return self.embedder.query(value)


class ImageSpace(VectorSpace):
    """Embedded images, with a description summed in where the field is ``blob + string``.

    ``image_embedder`` and ``text_embedder`` share one geometry; queries name which one they use.
    """

    accepts = (Blob, DescribedBlob)

    def __init__(self, image, image_embedder, text_embedder: TextEmbedder | None = None, salt: str | None = None):
        super().__init__(image, salt)
        self.image_embedder, self.text_embedder, self.length = image_embedder, text_embedder, image_embedder.length

    def source(self, schema):
        f = self.fields.get(schema)
        if f is None:
            return None
        if not isinstance(f, DescribedBlob):
            return self.raw(F.col(f.column))
        both = F.zip_with(self.image_embedder.column(F.col(f.blob.column)), self.text_embedder.column(F.col(f.text.column)), lambda a, b: a + b)
        return V.unit(both, self.length)

    def raw(self, c: Column) -> Column:
        return self.image_embedder.column(c)

    def _input(self, value):
        return self.text_embedder.query(value) if isinstance(value, str) else self.image_embedder.query(value)
