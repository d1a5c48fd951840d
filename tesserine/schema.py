"""Typed entity and event schemas, declared as classes, and the predicates that their fields build.

    class Paragraph(Schema):
        id: IdField
        body: String
        likes: Integer | None

    paragraph = Paragraph()
    paragraph.likes > 3

Entities have one id; events have one id, one creation time and references to entities. A field is
nullable when it is annotated ``X | None``; events have no nullable fields. Columns are cast to
the declared types where a DataFrame enters (decimals, dates and timestamps included).
"""

from __future__ import annotations

import re
import types
import typing
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Column with an id in the numbers that it came from.
KEY = "__key"
#: Column that orders the rows of one batch.
AT = "__at"


class SchemaError(ValueError):
    """A declaration or a query that cannot be right."""


EQUAL, ORDERED, LISTED = frozenset(["==", "!=", "in", "not_in"]), frozenset([">", "<", ">=", "<="]), frozenset(["contains", "not_contains", "contains_all"])


@dataclass(frozen=True)
class Predicate:
    """One comparison of a field with a value (or a parameter); ``|`` makes a group of alternatives."""

    field: Field
    op: str
    value: object

    def __or__(self, other: Predicate | AnyOf) -> AnyOf:
        return AnyOf((self,)) | other

    or_ = __or__

    @property
    def members(self) -> tuple[Predicate, ...]:
        return (self,)

    def column(self, value: object) -> Column:
        """The condition with the engine's own rules for missing values, never SQL's unknown.

        A missing value satisfies ``!=``, ``not_in`` and ``contains_all`` and no other operator.
        """
        # unknown counts as false in a filter, so only what a missing value satisfies is spelled out;
        # plain comparisons stay as they are and reach the file scan
        c = F.col(self.field.column)
        if self.op in ("in", "not_in", "contains", "not_contains", "contains_all"):
            values = list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]
            given = [v for v in values if v is not None]
            if self.op == "in":
                return c.isin(given) | c.isNull() if len(given) < len(values) else c.isin(given)
            if self.op == "not_in":
                return ~c.isin(given) & c.isNotNull() if len(given) < len(values) else ~c.isin(given) | c.isNull()
            array = F.array(*map(F.lit, given)).cast("array<string>")
            if self.op == "contains":
                return F.arrays_overlap(c, array) if given else F.lit(False)
            if self.op == "not_contains":
                return c.isNotNull() & ~F.coalesce(F.arrays_overlap(c, array), F.lit(False)) if given else c.isNotNull()
            return F.coalesce(F.size(F.array_except(array, c)) == 0, F.lit(True)) if given else F.lit(True)
        if self.op == "==":
            return c == F.lit(value) if value is not None else c.isNull()
        if self.op == "!=":
            return ~c.eqNullSafe(F.lit(value))
        other = F.lit(value)
        return {">": c > other, "<": c < other, ">=": c >= other, "<=": c <= other}[self.op]


@dataclass(frozen=True)
class AnyOf:
    """A group of alternatives: true where one member is."""

    members: tuple[Predicate, ...]

    def __or__(self, other: Predicate | AnyOf) -> AnyOf:
        return AnyOf(self.members + other.members)

    or_ = __or__


def condition(groups: list[list[tuple[Predicate, object]]]) -> Column | None:
    """AND over groups, OR inside; members are (predicate, bound value)."""
    each = [reduce(lambda a, b: a | b, [p.column(v) for p, v in g]) for g in groups if g]
    return reduce(lambda a, b: a & b, each) if each else None


@dataclass(eq=False)
class Field:
    """A column of a schema; comparisons give predicates."""

    spark_type: typing.ClassVar[T.DataType] = T.StringType()
    operators: typing.ClassVar[frozenset] = frozenset()
    name: str = ""
    schema: Schema | None = field(default=None, repr=False)
    nullable: bool = False

    __hash__ = object.__hash__

    @property
    def column(self) -> str:
        return self.name

    def _compare(self, op: str, value: object) -> Predicate:
        if op not in self.operators:
            raise SchemaError(f"{type(self).__name__} {self.name} has no {op}")
        return Predicate(self, op, value)

    def __eq__(self, other):  # noqa: D105
        return self._compare("==", other)

    def __ne__(self, other):
        return self._compare("!=", other)

    def __gt__(self, other):
        return self._compare(">", other)

    def __lt__(self, other):
        return self._compare("<", other)

    def __ge__(self, other):
        return self._compare(">=", other)

    def __le__(self, other):
        return self._compare("<=", other)

    def in_(self, values):
        return self._compare("in", values)

    def not_in_(self, values):
        return self._compare("not_in", values)

    def contains(self, values):
        return self._compare("contains", values)

    def not_contains(self, values):
        return self._compare("not_contains", values)

    def contains_all(self, values):
        return self._compare("contains_all", values)

    def read(self, c: Column) -> Column:
        """The column cast to this field's type."""
        return c.cast(self.spark_type)


def _epoch(c: Column, source: T.DataType) -> Column:
    return F.unix_timestamp(c.cast("timestamp")) if isinstance(source, (T.TimestampType, T.DateType, T.TimestampNTZType)) else c.cast("long")


class IdField(Field):
    operators = EQUAL

    @property
    def column(self) -> str:
        return "id"


class String(Field):
    operators = EQUAL

    def __add__(self, other: Blob) -> DescribedBlob:
        return DescribedBlob(other, self)


class Integer(Field):
    spark_type, operators = T.LongType(), EQUAL | ORDERED


class Float(Field):
    spark_type, operators = T.DoubleType(), ORDERED


class Timestamp(Field):
    """Unix seconds; dates and timestamps are converted."""

    spark_type, operators = T.LongType(), EQUAL | ORDERED


class Boolean(Field):
    spark_type, operators = T.BooleanType(), EQUAL

    def is_(self, value: bool) -> Predicate:
        return self == value

    def is_not_(self, value: bool) -> Predicate:
        return self != value


class FloatList(Field):
    spark_type = T.ArrayType(T.DoubleType())

    def read(self, c: Column) -> Column:
        return c.cast("array<double>")


class StringList(Field):
    spark_type, operators = T.ArrayType(T.StringType()), LISTED


class Blob(Field):
    spark_type = T.BinaryType()

    def __add__(self, other: String) -> DescribedBlob:
        return DescribedBlob(self, other)


@dataclass(frozen=True)
class DescribedBlob:
    blob: Blob
    text: String


class CreatedAtField(Timestamp):
    operators = frozenset()

    @property
    def column(self) -> str:
        return "created_at"


class SchemaReference(Field):
    """The id of an entity of another schema; ``2.0 * reference`` weights an effect."""

    target: type | None = None

    def __class_getitem__(cls, target):
        return type(f"ReferenceTo{getattr(target, '__name__', target)}", (cls,), {"target": target})

    def __mul__(self, weight: float) -> tuple[SchemaReference, float]:
        if not weight:
            raise SchemaError("a multiplier must not be 0")
        return self, float(weight)

    __rmul__ = __mul__


class Schema:
    """An entity type with exactly one id."""

    is_event = False

    def __init__(self):
        self.fields: dict[str, Field] = {}
        hints = typing.get_type_hints(type(self), localns={c.__name__: c for c in Field.__subclasses__()})
        for name, hint in hints.items():
            args = typing.get_args(hint) if isinstance(hint, types.UnionType) or typing.get_origin(hint) is typing.Union else (hint,)
            kinds = [a for a in args if isinstance(a, type) and issubclass(a, Field)]
            if len(kinds) != 1:
                continue
            f = kinds[0]()
            f.name, f.schema, f.nullable = name, self, type(None) in args
            self.fields[name] = f
            setattr(self, name, f)
        self._validate()

    @property
    def schema_name(self) -> str:
        return type(self).__name__

    def _one(self, kind: type) -> Field:
        found = [f for f in self.fields.values() if isinstance(f, kind)]
        if len(found) != 1 or found[0].nullable:
            raise SchemaError(f"{self.schema_name} needs exactly one {kind.__name__} that is not nullable")
        return found[0]

    def _validate(self) -> None:
        self.id_field = self._one(IdField)
        for name, kind in (("id", IdField), ("created_at", Timestamp)):
            if name in self.fields and not isinstance(self.fields[name], kind):
                raise SchemaError(f"{self.schema_name}.{name} must be a {kind.__name__}")
        if not self.is_event and any(isinstance(f, (CreatedAtField, SchemaReference)) for f in self.fields.values()):
            raise SchemaError(f"{self.schema_name} is no event schema")

    def read(self, df: DataFrame, mapping: dict[str, str] | None = None, keep_key: bool = False, order: str | None = None) -> DataFrame:
        """``df`` as this schema: mapped (dot paths reach into structs), cast and renamed; ``id`` is a string.

        Columns that a nullable field lacks are null. Rows without a usable id are an error when
        they are read. ``keep_key`` keeps an id column of whole numbers as ``KEY`` beside the id, so
        that a look-up by id reaches the scan; ``order`` names a column that says which of two rows
        is the later one, kept as ``AT``.
        """
        mapping = {k if isinstance(k, str) else k.name: v for k, v in (mapping or {}).items()}
        unknown = set(mapping) - set(self.fields)
        if unknown:
            raise SchemaError(f"{self.schema_name} has no {sorted(unknown)}")
        out = []
        for f in self.fields.values():
            path = mapping.get(f.name, f.name)
            head = path.split(".")[0]
            if head not in df.columns:
                if not f.nullable:
                    raise SchemaError(f"{self.schema_name}.{f.name} needs the column {path}")
                out.append(F.lit(None).cast(f.spark_type).alias(f.column))
                continue
            c = F.col(path)
            if isinstance(f, Timestamp):
                c = _epoch(c, df.select(path).schema[0].dataType)
            elif isinstance(f, IdField):
                if keep_key and isinstance(df.select(path).schema[0].dataType, (T.IntegerType, T.LongType)):
                    out.append(c.cast("long").alias(KEY))
                c = c.cast("string")
                c = F.when(c.isNull() | (F.trim(c) == "") | c.isin("NaN", "Infinity", "-Infinity"), F.raise_error(F.lit(f"{self.schema_name} has a row without an id")).cast("string")).otherwise(c)
            elif isinstance(f, (StringList, FloatList)) and not isinstance(df.select(path).schema[0].dataType, T.ArrayType):
                c = F.when(c.isNull(), None).otherwise(F.array(c))
                c = f.read(c)
            else:
                c = f.read(c)
            out.append(c.alias(f.column))
        return df.select(*out, *([F.col(order).alias(AT)] if order else []))


def with_ids(rows: DataFrame, ids) -> DataFrame:
    """Rows whose id is among ``ids`` (texts); where the id came from whole numbers these are compared in the scan."""
    found = rows.filter(F.col("id").isin(list(ids)))
    if KEY not in rows.columns:
        return found
    whole = [int(i) for i in ids if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", i) and -(1 << 63) <= int(i) < 1 << 63]
    return found.filter(F.col(KEY).isin(whole) if whole else F.lit(False))


def has_fields(fields) -> Column:
    """Rows that have a value in every one of ``fields``."""
    return reduce(lambda a, b: a & b, [F.col(f.column).isNotNull() for f in fields], F.lit(True))


class EventSchema(Schema):
    """An interaction: id, creation time and references; no nullable fields."""

    is_event = True

    def _validate(self) -> None:
        super()._validate()
        self.created_at = self._one(CreatedAtField)
        nullable = [f.name for f in self.fields.values() if f.nullable]
        if nullable:
            raise SchemaError(f"{self.schema_name} is an event: {nullable} must not be nullable")
