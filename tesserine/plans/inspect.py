"""Looking inside: plans, recency curves, sizes of vectors and files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators.index import Index
from tesserine.operators.spaces import Context, RecencySpace
from tesserine.plans.app import QueryResult


def recency_curve(spark: SparkSession, space: RecencySpace, now: int, points: int = 200) -> DataFrame:
    """(created_at, score) from before the longest period to now."""
    ctx = Context(now)
    longest = int(space.periods[-1].period_time.total_seconds())
    start = now - int(longest * 1.2)
    q = space.query([], [], ctx)
    at = spark.range(points).select((F.lit(start) + (F.col("id") * F.lit((now - start) / max(1, points - 1))).cast("long")).alias("created_at"))
    return at.select("created_at", space.score(F.col("created_at").cast("double"), q, 1.0, ctx).alias("score"))


def describe(index: Index) -> list[dict]:
    """One entry per space: position, name, length, offset in the vector and the schemas that fill it."""
    offsets = np.cumsum([0, *[s.length for s in index.spaces]]).tolist()
    return [{"position": i, "space": s.name, "length": s.length, "offset": o, "schemas": [x.schema_name for x in s.fields]} for i, (s, o) in enumerate(zip(index.spaces, offsets))]


def explain(result: QueryResult) -> str:
    """The physical plan of a query."""
    return result.frame._jdf.queryExecution().explainString(result.frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def vector_bytes(rows: DataFrame, index: Index) -> DataFrame:
    """(space, rows, bytes): what the stored parts take, at 8 bytes a dimension."""
    counted = rows.agg(*[F.count(index.raw_column(s)).alias(f"n{i}") for i, s in enumerate(index.spaces)])
    entries = F.array(*[F.struct(F.lit(s.name).alias("space"), F.col(f"n{i}").alias("rows"), (F.col(f"n{i}") * 8 * s.length).alias("bytes")) for i, s in enumerate(index.spaces)])
    return counted.select(F.inline(entries))


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) of the data files under ``path``, by their listing; none is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
