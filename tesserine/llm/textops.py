"""Shared plumbing: whole-text mappers over Arrow batches and small helpers.

``map_texts`` is the one way in which the per-document operators run Python: Spark
partitions the rows, each task sees Arrow batches, and a batch is cut into slices of
bounded size so that one worker never holds more than a slice of decoded texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from inspect import isgeneratorfunction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of an Arrow batch: rows are whole documents here, and Spark's default of 10,000 suits numbers.
BATCH_ROWS = "1000"
#: Bytes of text that a task decodes at a time.
SLICE_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS`` where it stands at Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def sized_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose ``column`` holds about ``limit`` bytes (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list], list]],
    columns: list[tuple[str, T.DataType]],
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """One row per row of ``df``: its id and the columns that the mapper computes from its whole text.

    ``make`` builds the mapper once per task; the mapper takes a list of texts (null: None)
    and returns one list per output column. A ``make`` that yields its mapper goes on at the end
    of the task, to release what it holds. Other columns of ``df`` are not read, so names
    that clash with an output column do no harm.
    """
    small_batches(df.sparkSession)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)] + [T.StructField(n, t) for n, t in columns])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextmanager(make)() if isgeneratorfunction(make) else nullcontext(make()) as mapper:
            for batch in batches:
                for part in sized_slices(batch, 1, limit):
                    out = mapper(part.column(1).to_pylist())
                    arrays = [part.column(0).cast(arrow.field(0).type)]
                    arrays += [pa.array(v, type=arrow.field(k + 1).type) for k, v in enumerate(out)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def hash_share(df: DataFrame, columns: list[str], rows: int, seed: int) -> DataFrame:
    """Rows chosen by the hash of ``columns``, some twice ``rows`` different ones (all rows of a smaller table).

    Narrows a bounded sample for a fit before it is ordered and limited, so that what tasks
    return for it does not grow with their number. ``columns`` should tell rows apart (id and text):
    rows that are equal in all of them are taken or left together and count once.
    """
    h = F.xxhash64(*[F.col(c).cast("string") for c in columns], F.lit(seed))
    total = df.agg(F.approx_count_distinct(h)).first()[0]
    if total <= 2 * rows:
        return df
    return df.filter(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 2 * rows / total))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``, or one in the warehouse where it is unset (local tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def write_shared(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder, never over the cluster's own setting."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def write_table(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, for what is read column by column or more than once.

    The folder is removed when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = 1000, limit: int = 1_000_000) -> DataFrame:
    """``left`` joined with ``right``, which has one row per ``key`` (or few), however often ``left`` repeats a key.

    A key that ``left`` has more than ``most`` times is split: its rows get a salt by their hash and
    the key's row on the right is copied once per salt, so that a task meets about ``most`` rows of
    one key. The repeated keys are counted under partial aggregation; they are broadcast while there
    are at most ``limit`` of them (and are at most 1/``most`` of the rows), else joined by shuffle.
    """
    hot = left.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("__salts")).filter("__salts > 1")
    hot = write_shared(hot)
    n = hot.count()
    if not n:
        return left.join(right, key, how)
    small = F.broadcast(hot.coalesce(1)) if n <= limit else hot
    row = F.xxhash64(*[F.col(c) for c in left.columns])
    salted = left.join(small, key, "left").withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(row, F.col("__salts")))).drop("__salts")
    copies = right.join(small, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return salted.withColumn("__salt", F.col("__salt").cast("int")).join(copies, [key, "__salt"], how).drop("__salt")
