"""What is kept between runs: embeddings by text, rows in buckets by id, rows clustered for filters."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.text import TextEmbedder
from tesserine.schema import AT
from tesserine.sources.store import last_of


@dataclass(frozen=True, eq=False)
class StoredEmbeddings:
    """Vectors of texts under ``path``, by the SHA-256 of the text; one folder per model.

    A text is embedded once, in whatever run it comes first and however often it occurs: distinct texts
    that the table lacks are embedded and added as a new part of it. Runs that add at the same time
    may both embed a text; it is read once. A run that fails leaves its part unread, since a part is
    listed only when Spark has committed it.
    """

    spark: SparkSession
    path: str
    embedder: TextEmbedder

    def _known(self) -> DataFrame:
        parts = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part=*/_SUCCESS")
        found = parts.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(parts)
        schema = "key binary, vector array<double>"
        done = [f.getPath().getParent().toString() for f in found or ()]
        return self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)

    @staticmethod
    def key(text: Column) -> Column:
        return F.unhex(F.sha2(text.cast("binary"), 256))

    def add(self, df: DataFrame, text_col: str) -> int:
        """Embed the texts of ``df`` that are new; how many there were."""
        texts = df.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
        each = texts.withColumn("key", self.key(F.col("text"))).groupBy("key").agg(F.first("text").alias("text"))
        part = f"{self.path}/part={uuid.uuid4().hex}"
        fresh = each.join(self._known().select("key"), "key", "left_anti")
        fresh.select("key", self.embedder.column(F.col("text")).alias("vector")).write.parquet(part)
        return self.spark.read.schema("key binary").parquet(part).count()

    def vectors(self, df: DataFrame, text_col: str, name: str = "vector") -> DataFrame:
        """``df`` with the vectors of its texts, zeros for null; new texts are embedded first."""
        self.add(df, text_col)
        once = self._known().groupBy(F.col("key").alias("__key")).agg(F.first("vector").alias("__vector"))
        keyed = df.withColumn("__key", self.key(F.col(text_col).cast("string")))
        met = keyed.join(once, "__key", "left").drop("__key")
        return met.withColumn(name, F.coalesce("__vector", F.array_repeat(F.lit(0.0), self.embedder.length))).drop("__vector")


@dataclass(eq=False)
class BucketedRows:
    """Rows of one schema in a table with buckets by id, so that an update shuffles the new rows alone.

    Every update writes the next version of the table and drops the one before last: readers of the
    last version are not disturbed. Fields of new rows replace old ones where they are not null.
    """

    spark: SparkSession
    name: str
    buckets: int = 64
    version: int = 0

    @property
    def table(self) -> str:
        return f"{self.name}_{self.version}"

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def merged(self, new: DataFrame) -> DataFrame:
        """Stored rows and ``new`` ones (one row per id) as one table."""
        if not self.version:
            return new
        old = self.rows()
        fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != "id"]
        sides = old.alias("o").join(new.hint("shuffle_merge").alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
        pick = lambda c: F.coalesce(*[F.col(f"{side}.{c}") for side, df in (("n", new), ("o", old)) if c in df.columns]).alias(c)
        return sides.select(F.coalesce("n.id", "o.id").alias("id"), *[pick(c) for c in fields])

    def update(self, batch: DataFrame, order: str | None = None) -> DataFrame:
        """Merge a batch in; the rows of the new version."""
        new = last_of(batch, "id", order).drop(AT)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{self.version + 1}")
        self.merged(new).write.bucketBy(self.buckets, "id").sortBy("id").format("parquet").saveAsTable(f"{self.name}_{self.version + 1}")
        self.version += 1
        if self.version > 2:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{self.version - 2}")
        return self.rows()

    def drop(self) -> None:
        for v in (self.version - 1, self.version):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{v}")


#: Quantiles of a column that the order of a clustered table knows.
STEPS = 64


def curve(df: DataFrame, columns: list[str]) -> Column:
    """A row's place on the Z-order curve over its columns' quantiles; null comes first.

    Texts are placed by their first seven bytes; only the place of a row depends on that, never its values.
    """
    bits = STEPS.bit_length() - 1
    kinds = dict(df.dtypes)
    number = {c: F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("double") if kinds[c] == "string" else F.col(c).cast("double") for c in columns}
    cuts = df.select(*[number[c].alias(f"c{i}") for i, c in enumerate(columns)]).approxQuantile([f"c{i}" for i in range(len(columns))], [(i + 1) / STEPS for i in range(STEPS - 1)], 1 / (4 * STEPS))
    place = {c: reduce(lambda a, b: a + b, [F.coalesce((number[c] > F.lit(x)).cast("long"), F.lit(0)) for x in sorted(set(q))], F.lit(0).cast("long")) for c, q in zip(columns, cuts)}
    out = F.lit(0).cast("long")
    for bit in range(bits):
        for i, c in enumerate(columns):
            out = out.bitwiseOR(F.call_function("shiftleft", F.shiftright(place[c], bit).bitwiseAND(F.lit(1)), F.lit(bit * len(columns) + i)))
    return out


def persist_clustered(df: DataFrame, path: str, columns: list[str], bloom: tuple[str, ...] = ("id",), files: int | None = None, row_group: int = 64 << 20) -> None:
    """Write ``df`` in the Z-order of ``columns``, so that the bounds in Parquet's footers let a filter on any of them skip row groups.

    ``bloom`` columns get Bloom filters, for look-ups of single values. ``files`` is the number of ranges (Spark's
    shuffle partitions by default), ``row_group`` their row groups' size in bytes.
    """
    ordered = df.withColumn("__curve", curve(df, columns))
    ordered = ordered.repartitionByRange(files, "__curve") if files else ordered.repartitionByRange("__curve")
    writer = ordered.sortWithinPartitions("__curve", *columns).drop("__curve").write.option("parquet.block.size", row_group)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
