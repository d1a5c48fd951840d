"""Where rows come from: files of every supported format, in-memory rows, blobs and streams."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.schema import AT, Schema, SchemaError


class DataFormat(Enum):
    CSV = "csv"
    FWF = "fwf"
    XML = "xml"
    JSON = "json"
    PARQUET = "parquet"
    ORC = "orc"


@dataclass(frozen=True)
class DataLoaderConfig:
    """A path, its format and reader options; ``widths`` are the columns (name, start from 1, length) of fixed-width text."""

    path: str
    format: DataFormat
    name: str | None = None
    options: dict = field(default_factory=dict)
    widths: tuple[tuple[str, int, int], ...] = ()


def load(spark: SparkSession, config: DataLoaderConfig, schema: T.StructType | None = None) -> DataFrame:
    """A lazy, splittable read; nothing passes through the driver."""
    if config.format is DataFormat.FWF:
        lines = spark.read.options(**config.options).text(config.path)
        return lines.select(*[F.trim(F.substring("value", start, n)).alias(name) for name, start, n in config.widths])
    defaults = {DataFormat.CSV: {"header": "true", "inferSchema": "true"}, DataFormat.XML: {"rowTag": "row"}}.get(config.format, {})
    reader = spark.read.options(**{**defaults, **config.options})
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(config.format.value).load(config.path)


def load_stream(spark: SparkSession, config: DataLoaderConfig, schema: T.StructType) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).options(**config.options).format(config.format.value).load(config.path)


def load_blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as (id, blob): the path and the bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("id"), F.col("content").alias("blob"))


def decode_blob(c):
    """Bytes of a base64 text column; null where it is none."""
    return F.when(c.rlike(r"^[A-Za-z0-9+/\s]*={0,2}\s*$"), F.try_to_binary(c, F.lit("base64")))


def from_rows(spark: SparkSession, schema: Schema, rows: Iterable[dict], mapping: dict[str, str] | None = None) -> DataFrame:
    """Small in-memory rows (dictionaries, nested ones by dot paths) in the schema's form."""
    rows = [rows] if isinstance(rows, dict) else list(rows)
    mapping = {k if isinstance(k, str) else k.name: v for k, v in (mapping or {}).items()}
    out = []
    for row in rows:
        values = []
        for f in schema.fields.values():
            value = row
            for step in mapping.get(f.name, f.name).split("."):
                value = value.get(step) if isinstance(value, dict) else None
            if value is None and not f.nullable:
                raise SchemaError(f"{schema.schema_name}.{f.name} is missing in {row}")
            if isinstance(f.spark_type, T.ArrayType) and value is not None:
                item = float if isinstance(f.spark_type.elementType, T.DoubleType) else str
                value = [item(v) for v in (value if isinstance(value, (list, tuple)) else [value])]
            elif value is not None:
                kind = {T.LongType: lambda v: int(v.timestamp()) if hasattr(v, "timestamp") else int(v), T.DoubleType: float, T.BooleanType: bool, T.BinaryType: bytes}.get(type(f.spark_type), str)
                value = kind(value)
            values.append(value)
        out.append(tuple(values))
    types = T.StructType([T.StructField(f.name, f.spark_type) for f in schema.fields.values()] + [T.StructField(AT, T.LongType())])
    df = spark.createDataFrame([(*v, i) for i, v in enumerate(out)], types)
    return schema.read(df, order=AT)


def from_json(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """Fields of a JSON text column by dot path, beside the other columns."""
    return df.select("*", *[F.get_json_object(column, "$." + p).alias(n) for n, p in paths.items()])


def to_json(df: DataFrame, schema: Schema, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rows in the schema's form as JSON texts, nested along the dot paths of ``mapping``."""
    tree: dict = {}
    for f in schema.fields.values():
        at = tree
        *path, last = (mapping or {}).get(f.name, f.name).split(".")
        for step in path:
            at = at.setdefault(step, {})
        at[last] = F.col(f.column)

    def build(node):
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])

    return df.select(F.to_json(build(tree)).alias("value"))
