"""Exact search that reads few rows: cells of directions with bounds.

The rows of an index are dealt to cells by the nearest of some unit vectors (spherical k-means on
a bounded sample; every row is assigned) and written as one Parquet partition per cell, each sorted
by the angle to its centre. A cell knows its smallest and greatest angle and length. By the
triangle inequality of angles a query at the angle f to a centre has, with a row at the angle a, an
angle of at least |f - a|, which bounds every score in a cell and every score at one angle.

A radius reads the cells whose bound reaches it. A limit k reads the cells of the highest bounds
until k rows passed the filters; the k-th score then names all the other cells, and the angles in
them, that may hold a better row. Results equal those of the plain scan.

Defined cases: rows whose vector is missing or zero are a cell of their own with the bound 0; without
a limit and a radius all cells are read; an empty table gives an empty result. Vectors of recency
spaces change with the clock, so an index with one answers queries at the time of its making alone.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.functions.clusters import k_means, nearest, sample_matrix
from tesserine.operators.index import Index
from tesserine.operators.spaces import Context, RecencySpace
from tesserine.plans.query import block_top_k
from tesserine.schema import SchemaError
from tesserine.sources.store import kept_for_session, write_shared

#: Cells of an index at most, whose centres and bounds the driver holds; cells whose angles are named one by one in a filter.
MOST_CELLS, NAMED_CELLS = 4096, 64
#: Rows of a cell, and queries, that meet in one task.
ROWS_MET, QUERIES_MET = 100_000, 4096
#: What rounding may add to a score.
SLACK = 1e-9

CELLS = "cell int, n long, least double, greatest double, shortest double, longest double"


@dataclass(frozen=True, eq=False)
class CellIndex:
    """Rows of ``index`` under ``path``, their centres and the bounds of the cells (``CELLS``)."""

    spark: SparkSession
    index: Index
    path: str
    centres: np.ndarray
    cells: dict[str, np.ndarray]
    now: int
    schema: T.StructType

    @classmethod
    def build(cls, rows: DataFrame, index: Index, now: int, path: str | None = None, cells: int | None = None, seed: int = 1) -> CellIndex:
        """Deal ``rows`` (as ``App.rows`` gives them) to about ``cells`` cells (by default the square root of their number) and write them."""
        spark = rows.sparkSession
        path = path or kept_for_session(spark, "cells")
        vectors = index.with_vectors(rows, Context(now), "__vector")
        n = vectors.count()
        sample = sample_matrix(vectors, index.length, "id", "__vector", seed)
        centres = k_means(sample, max(1, min(MOST_CELLS, cells or math.isqrt(n))), spherical=True, seed=seed) if len(sample) else np.zeros((0, index.length))
        dealt = _dealt(vectors, centres, index.length).drop("__vector")
        # a cell with very many rows is split among tasks and files
        dealt.hint("rebalance", "cell").sortWithinPartitions("cell", "angle").write.partitionBy("cell").parquet(f"{path}/rows")
        stored = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
        bounds = stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("greatest"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
        bounds.coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        spark.createDataFrame([(now, dealt.schema.json())], "now long, schema string").coalesce(1).write.parquet(f"{path}/about")
        return cls.open(spark, index, path)

    @classmethod
    def open(cls, spark: SparkSession, index: Index, path: str) -> CellIndex:
        """An index that was built under ``path``."""
        found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS rows at most, as are the bounds
        centres = np.array([r.centre for r in found]).reshape(-1, index.length)
        bounds = spark.read.schema(CELLS).parquet(f"{path}/cells").orderBy("cell").toArrow()
        about = spark.read.parquet(f"{path}/about").first()
        return cls(spark, index, path, centres, {c: bounds[c].to_numpy() for c in bounds.column_names}, about.now, T.StructType.fromJson(json.loads(about.schema)))

    def rows(self, chosen: np.ndarray, angles: list[tuple[float, float]] | None = None) -> DataFrame:
        """The rows of some cells, on demand those between two angles of each."""
        names = [int(c) for c in self.cells["cell"][chosen]]
        df = self._stored()
        df = df.filter(F.col("cell").isin(names)) if names else df.limit(0)
        if angles is not None and 0 < len(names) <= NAMED_CELLS:
            some = F.lit(False)
            for name, (lo, hi) in zip(names, angles):
                some = some | (F.col("cell") == name) & F.col("angle").between(lo, hi)
            df = df.filter(some)
        return df.drop("cell", "angle", "length")

    def _angles(self, q: np.ndarray) -> np.ndarray:
        """The angle between the query (or each row of a matrix of queries) and each cell's centre."""
        return _angles(q, self.centres, self.cells)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Per cell a score that none of its rows exceeds, for a query or each row of a matrix."""
        return _bounds(q, self.centres, self.cells)

    def selected(self, plan) -> tuple[np.ndarray, float]:
        """The cells that a bound query reads (a mask) and the score from which rows count."""
        if any(isinstance(s, RecencySpace) for s in self.index.spaces) and plan.context.now != self.now:
            raise SchemaError("cells of an index with a recency space hold for the time of their making")
        q = plan.search_vector
        bounds = self.bounds(q)
        least = plan.least
        if plan.limit and plan.limit > 0:
            order = np.argsort(-bounds, kind="stable")
            have = np.cumsum(self.cells["n"][order])
            take = int(np.searchsorted(have, plan.limit)) + 1
            while take < len(order):
                found = plan.frame(self.rows(order[:take])).agg(F.count("*"), F.min("score")).first()
                if found[0] >= plan.limit:
                    least = max(least, found[1])
                    break
                take *= 2  # filters left too few
        return bounds >= least - SLACK, least

    def frame(self, plan) -> DataFrame:
        """The result of ``plan`` (see ``QueryPlan.frame``) from the cells that it needs."""
        chosen, least = self.selected(plan)
        q = plan.search_vector
        size = np.linalg.norm(q) * self.cells["longest"][chosen]
        at = self._angles(q)[chosen]
        with np.errstate(invalid="ignore", divide="ignore"):
            reach = np.where((least > 0) & (size > 0), np.arccos(np.clip((least - 2 * SLACK) / np.where(size > 0, size, 1), -1, 1)) + 1e-6, math.pi)
        free = self.cells["cell"][chosen] < 0
        return plan.frame(self.rows(np.flatnonzero(chosen), [(-1.0, 4.0) if f else (a - r, a + r) for a, r, f in zip(at, reach, free)]))

    def batch(self, queries: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
        """Exact top ``k`` rows for each of many query vectors: query_id, id, score, rank (ties by id), as ``batch_top_k``.

        Every query first meets the cells of the highest bounds that hold ``k`` rows; its k-th score then
        names the other cells that it must meet. Cells of many rows, and the queries of a cell, are split by count.
        """
        asked = write_shared(queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).filter("v is not null"))
        stored = self.index.with_vectors(self._stored(), Context(self.now), "v").select("id", "cell", "v")
        best = self._met(self._sent(asked, k), stored, k)
        best = write_shared(best)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        kth = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("least"))
        more = self._met(self._sent(asked.join(kth, "q", "left"), k, True), stored, k)
        return best.union(more).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def _sent(self, asked: DataFrame, k: int, again: bool = False) -> DataFrame:
        """(q, v, cell): the cells that queries meet first, or ``again`` those that may hold better rows than the k-th (``least``)."""
        centres, cells = self.centres, self.cells
        schema = T.StructType([asked.schema["q"], asked.schema["v"], T.StructField("cell", T.IntegerType())])

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    m = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    bounds = _bounds(m, centres, cells)
                    order = np.argsort(-bounds, axis=1, kind="stable")
                    before = np.cumsum(cells["n"][order], axis=1) - cells["n"][order]
                    first = np.zeros(bounds.shape, bool)
                    np.put_along_axis(first, order, before < k, 1)
                    if again:
                        least = part.column(2).fill_null(-math.inf).to_numpy(zero_copy_only=False)
                        first = ~first & (bounds >= least[:, None] - SLACK)
                    row, cell = np.nonzero(first)
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(cells["cell"][cell], pa.int32())], names=schema.names)

        return asked.select("q", "v", *["least"] * again).mapInArrow(run, schema)

    def _met(self, sent: DataFrame, stored: DataFrame, k: int) -> DataFrame:
        """query_id, id, score: the best ``k`` of each block of a cell for the queries that were sent there."""
        sent = write_shared(sent)
        asked = {r.cell: r.n for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per cell
        if not asked:
            return self.spark.createDataFrame([], T.StructType([T.StructField("query_id", sent.schema["q"].dataType), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())]))
        splits = [(int(c), -(-int(n) // ROWS_MET), -(-asked[c] // QUERIES_MET)) for c, n in zip(self.cells["cell"], self.cells["n"]) if c in asked]
        split = F.broadcast(self.spark.createDataFrame(splits, "cell int, blocks int, groups int"))
        grid = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = sent.join(split, "cell").withColumn("g", F.pmod(F.xxhash64("q", "v"), F.col("groups")).cast("int")).withColumn("b", grid("blocks"))
        names = list(asked)
        right = stored.filter(F.col("cell").isin(names)).join(split, "cell").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("g", grid("groups"))
        schema = T.StructType([T.StructField("query_id", sent.schema["q"].dataType), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())])
        length = self.index.length

        def best_of(queries: pa.Table, rows: pa.Table) -> pa.Table:
            return block_top_k(queries, rows, length, k)

        key = ["cell", "b", "g"]
        return left.select(*key, "q", "v").groupBy(*key).cogroup(right.select(*key, "id", "v").groupBy(*key)).applyInArrow(best_of, schema)

    def share_read(self, plan) -> float:
        """The share of cells that ``plan`` reads."""
        chosen = self.selected(plan)[0]
        return float(chosen.mean()) if len(chosen) else 0.0


def _angles(q: np.ndarray, centres: np.ndarray, cells: dict[str, np.ndarray]) -> np.ndarray:
    own, size = cells["cell"], np.linalg.norm(q, axis=-1, keepdims=True)
    cos = np.zeros((*q.shape[:-1], len(own)))
    real = own >= 0
    cos[..., real] = q @ centres[own[real]].T / np.where(size > 0, size, 1.0)
    return np.arccos(np.clip(cos, -1, 1))


def _bounds(q: np.ndarray, centres: np.ndarray, cells: dict[str, np.ndarray]) -> np.ndarray:
    at = _angles(q, centres, cells)
    nearest_angle = np.maximum(0, np.maximum(cells["least"] - at, at - cells["greatest"]))
    cos = np.cos(np.minimum(nearest_angle, math.pi))
    best = np.linalg.norm(q, axis=-1, keepdims=True) * np.where(cos > 0, cells["longest"], cells["shortest"]) * cos
    return np.where(cells["cell"] < 0, 0.0, best) + SLACK


def _dealt(vectors: DataFrame, centres: np.ndarray, length: int) -> DataFrame:
    """``vectors`` with cell, angle to its centre and length of the vector."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("length", T.DoubleType())])
    at = vectors.columns.index("__vector")

    def run(batches):
        for batch in batches:
            m = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            size = np.linalg.norm(m, axis=1)
            cell, cos = np.full(len(m), -1), np.zeros(len(m))
            real = size > 0
            if len(centres) and real.any():
                own = nearest(m[real], centres, True)
                cell[real], cos[real] = own, (m[real] * centres[own]).sum(axis=1) / size[real]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(np.arccos(np.clip(cos, -1, 1))), pa.array(size)], names=[f.name for f in schema])

    return vectors.mapInArrow(run, schema)
