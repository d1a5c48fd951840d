"""Approximate search over compressed vectors, with exact scores for what it finds.

Product quantisation: a vector is cut into equal parts, and every part is replaced by the number of
its nearest centre among at most 256 (k-means on a bounded sample; every row is encoded). A query's
inner products with all centres make a small table, so that the score of a row is a sum of
``parts`` entries. Only codes are read for that; the best ``candidates`` of each query then
meet their whole vectors, which give the exact scores and the order.

The result may lack rows whose code is far from their vector; ``recall`` measures how many of the true
ones are found, and ``batch_top_k`` is the exact way. With ``candidates`` of all rows codes have nothing to choose: the exact way is
taken, which holds ``k`` rows per query and block instead of a row per query and candidate.

Defined cases: rows and queries without a vector are left out; of rows that share an id each takes part; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.functions.clusters import k_means, nearest, sample_matrix
from tesserine.functions.vectors import dot_columns
from tesserine.plans.query import batch_top_k
from tesserine.schema import SchemaError
from tesserine.sources.store import kept_for_session

CENTRES = 256


@dataclass(frozen=True, eq=False)
class Codebook:
    """Centres by part: an array (part, centre, number)."""

    centres: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, parts: int, seed: int = 1) -> Codebook:
        if sample.shape[1] % parts:
            raise SchemaError(f"{sample.shape[1]} numbers do not make {parts} equal parts")
        size = sample.shape[1] // parts
        out = np.zeros((parts, CENTRES, size))
        for j in range(parts):
            found = k_means(sample[:, j * size : (j + 1) * size], CENTRES, seed=seed + j) if len(sample) else np.zeros((1, size))
            out[j, : len(found)] = found
            out[j, len(found) :] = found[0]  # never the nearest before the first
        return cls(out)

    @property
    def parts(self) -> int:
        return len(self.centres)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """The numbers of the nearest centres."""
        size = self.centres.shape[2]
        return np.stack([nearest(vectors[:, j * size : (j + 1) * size], c, False) for j, c in enumerate(self.centres)], axis=1).astype(np.int16)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products (query, part, centre)."""
        return np.einsum("qps,pcs->qpc", queries.reshape(len(queries), self.parts, -1), self.centres)

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores of encoded rows for each query: what the inner products with the centres' vectors would be."""
        tables, codes = self.tables(queries), codes.astype(np.int64)
        out = np.zeros((len(queries), len(codes)))
        for j in range(self.parts):
            out += tables[:, j].take(codes[:, j], axis=1)
        return out


@dataclass(frozen=True, eq=False)
class CodeIndex:
    """Ids, codes and vectors of rows under ``path``; a search reads ids and codes, and vectors of candidates alone."""

    spark: SparkSession
    path: str
    book: Codebook
    length: int

    @classmethod
    def build(cls, rows: DataFrame, length: int, parts: int = 16, path: str | None = None, id_col: str = "id", vector_col: str = "vector", seed: int = 1) -> CodeIndex:
        spark = rows.sparkSession
        path = path or kept_for_session(spark, "codes")
        given = rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vector is not null")
        book = Codebook.fit(sample_matrix(given, length, seed=seed), parts, seed)
        schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("code", T.ArrayType(T.ShortType()))])

        def run(batches):
            for batch in batches:
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
                code = pa.FixedSizeListArray.from_arrays(pa.array(book.encode(m).ravel()), book.parts).cast(pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code], names=schema.names)

        given.mapInArrow(run, schema).write.parquet(f"{path}/rows")
        spark.createDataFrame([(j, c.ravel().tolist()) for j, c in enumerate(book.centres)], "part int, centres array<double>").coalesce(1).write.parquet(f"{path}/book")
        return cls(spark, path, book, length)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CodeIndex:
        found = spark.read.parquet(f"{path}/book").orderBy("part").collect()  # a row per part
        book = Codebook(np.array([r.centres for r in found]).reshape(len(found), CENTRES, -1))
        return cls(spark, path, book, book.parts * book.centres.shape[2])

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id string, vector array<double>, code array<short>").parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, candidates: int | None = None, query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
        """query_id, id, score (exact), rank of the ``k`` best of each query's ``candidates`` (ten times ``k``)."""
        if candidates is not None and candidates >= self.rows().count():  # codes can choose nothing: rows meet queries block by block, and no pair is written
            return batch_top_k(self.rows(), queries, self.length, k, query_id=query_id, query_vector=query_vector)
        near = batch_top_k(self.rows(), queries, self.length, candidates or 10 * k, vector_col="code", query_id=query_id, query_vector=query_vector, scores=self.book.scores, row_length=self.book.parts)
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("query"))
        whole = near.select("query_id", "id").distinct().join(self.rows().select("id", "vector"), "id").join(asked, "query_id")
        exact = whole.select("query_id", "id", F.round(dot_columns("vector", "query"), 9).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return exact.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)

    def recall(self, queries: DataFrame, k: int, candidates: int | None = None) -> DataFrame:
        """Per query how many of the ``k`` true best rows the search finds: query_id, found, wanted."""
        true = batch_top_k(self.rows(), queries, self.length, k)
        found = self.search(queries, k, candidates).select("query_id", "id", F.lit(1).alias("hit"))
        return true.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("hit").alias("found"), F.count("*").alias("wanted"))
