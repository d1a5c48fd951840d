"""Keeping rows: field-wise upserts, persisted tables, half precision, and a tee for raw messages."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.schema import AT


def _placed(df: DataFrame, order: str | None) -> DataFrame:
    """``df`` with ``AT``: the column ``order`` where one is named, else what the batch brings, else a hash of the row."""
    if order is None and AT in df.columns:
        return df
    at = F.col(order) if order else F.xxhash64(*[F.to_json(F.struct(*df.columns))])
    return df.withColumn(AT, at)


def last_of(df: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One row per key: of repeated rows the later non-null value of each field.

    ``order`` names the column that says which is later. In-memory rows bring their own order; for
    other rows that repeat a key without one, the row with the greatest hash counts as the later,
    which is the same in every run.
    """
    return merged([df], key, order)


def merged(batches: list[DataFrame], key: str = "id", order: str | None = None) -> DataFrame:
    """All batches merged by key in one shuffle: per field the last non-null value, later batches first."""
    placed = [_placed(df, order) for df in batches]
    kinds = {df.schema[AT].dataType.simpleString() for df in placed}
    rows = [df.withColumn(AT, F.struct(F.lit(i).alias("batch"), (F.col(AT) if len(kinds) == 1 else F.col(AT).cast("long")).alias("at"))) for i, df in enumerate(placed)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    fields = [c for c in dict.fromkeys(c for df in batches for c in df.columns) if c not in (key, AT)]
    return both.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(AT))).alias(c) for c in fields]).select(key, *fields)


def upsert(old: DataFrame | None, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows merged by key: new non-null fields replace old ones, everything else stays."""
    return merged([new] if old is None else [old, new], key)


def newest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Whole newest row per key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def to_half(vector: Column) -> Column:
    """Vectors as the bits of 16-bit floats, for storage alone."""

    @F.pandas_udf("array<short>")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.array(v, np.float16).view(np.int16))

    return pack(vector)


def from_half(bits: Column) -> Column:
    @F.pandas_udf("array<double>")
    def unpack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.array(v, np.int16).view(np.float16).astype(float))

    return unpack(bits)


def persist(df: DataFrame, path: str, half: bool = False, partition_by: list[str] | None = None) -> None:
    """Write indexed rows as Parquet; ``half`` stores vectors as 16-bit floats (three digits, up to 65,504)."""
    if half:
        df = df.select(*[to_half(F.col(c)).alias(c) if t == "array<double>" else F.col(c) for c, t in df.dtypes])
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    wide = {"array<smallint>": from_half, "array<float>": lambda c: c.cast("array<double>")}
    return df.select(*[wide[t](F.col(c)).alias(c) if t in wide else F.col(c) for c, t in df.dtypes])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); one beside the warehouse where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def kept_for_session(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares, removed when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)  # only what exists can be marked
    fs.deleteOnExit(path)
    return path.toString()


def write_shared(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder that the cluster shares; the session's own part of it is removed at its end."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    cut = df.checkpoint(eager=True)
    own = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return cut


def write_columns(df: DataFrame) -> DataFrame:
    """``df`` of numbers or text written once as Parquet, as ``write_shared`` does with rows; for what is large and read more than once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/columns-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def tee(stream: DataFrame, sink: Callable[[DataFrame, int], None], publish: Callable[[DataFrame], None], checkpoint: str):
    """Run a stream into ``sink`` and hand every micro-batch's raw rows to ``publish`` as well (a queue, say)."""

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        publish(batch)
        sink(batch, number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).start()
