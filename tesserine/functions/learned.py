"""Word vectors learned from the corpus itself, and texts as their weighted means.

Words that stand near each other are counted over all texts; the counts become positive pointwise
mutual information; the strongest directions of that matrix, found by a randomised decomposition,
are the word vectors. A text is the mean of its words' vectors, rare words counting more, brought
to unit length.

Counting is one pass with sums inside tasks and partial aggregation. The matrix stays in Spark, dealt by
its rows; each of the few multiplications sends the tall thin factor (``vocabulary`` rows of
``length + EXTRA`` numbers, the bound of all that the driver holds) to the tasks and brings the next one back.

Defined cases: null texts and texts without known words are zeros; a corpus without pairs gives no
words; the same corpus gives the same vectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.functions.vectors import l2
from tesserine.sources.store import write_columns, write_shared

#: Words of the vocabulary at most (the most frequent), texts' words on either side that count as near, and least occurrences.
VOCABULARY, WINDOW, LEAST = 20_000, 5, 3
#: Directions beyond those asked for, and multiplications that sharpen them.
EXTRA, SHARPEN = 16, 3
#: A word of this share of all words counts half.
HALF = 1e-3
#: Rows of the matrix that a task holds whole at a time (8 bytes times the vocabulary each).
DENSE = 128
#: Counts that a task adds up at a time.
FLUSH = 1 << 22
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return WORDS.findall(text.lower()) if text else []


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=schema.names)

        for batch in batches:
            for text in batch.column(0):
                for w in words_of(text.as_py()):
                    held[w] = held.get(w, 0) + 1
                if len(held) > 500_000:
                    yield told()
                    held.clear()
        if held:
            yield told()

    return texts.select(F.col(text_col).cast("string")).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, size: int = VOCABULARY, least: int = LEAST) -> tuple[list[str], np.ndarray]:
    """The most frequent words (ties by word) and their counts; ``size`` rows at most."""
    rows = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).collect()
    return [r.word for r in rows], np.array([r.n for r in rows], np.int64)


def pair_counts(texts: DataFrame, text_col: str, words: list[str], window: int = WINDOW) -> DataFrame:
    """(a, b, n): how often the words numbered a and b stand at most ``window`` words apart, in both orders."""
    sent, size = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)}), len(words)
    schema = T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = sent.value.get, [], 0

        def told():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=schema.names)

        for batch in batches:
            for text in batch.column(0):
                found = words_of(text.as_py())
                x = np.fromiter((number(w, -1) for w in found), np.int64, len(found))
                for d in range(1, window + 1):
                    a, b = x[:-d], x[d:]
                    both = (a >= 0) & (b >= 0)
                    held.append(np.minimum(a, b)[both] * size + np.maximum(a, b)[both])
                    rows += len(held[-1])
                if rows > FLUSH:
                    yield told()
                    held, rows = [], 0
        if rows:
            yield told()

    half = texts.select(F.col(text_col).cast("string")).mapInArrow(run, schema).groupBy("code").agg(F.sum("n").alias("n"))
    half = half.select(F.floor(F.col("code") / size).cast("int").alias("a"), (F.col("code") % size).cast("int").alias("b"), "n")
    own = F.col("a") == F.col("b")  # a word beside itself counts in both orders, too
    both = F.when(own, F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(F.explode(both).alias("pair"), F.when(own, 2 * F.col("n")).otherwise(F.col("n")).alias("n")).select("pair.a", "pair.b", "n")


def information(pairs: DataFrame) -> DataFrame:
    """(a, b, n, ppmi): ln(n * all / (a's * b's)), nothing below 0."""
    sums = pairs.groupBy("a").agg(F.sum("n").alias("of"))  # one row per word
    all_ = pairs.agg(F.sum("n").alias("all"))
    met = pairs.join(F.broadcast(sums), "a").join(F.broadcast(sums.toDF("b", "of_b")), "b").crossJoin(F.broadcast(all_))  # one row
    return met.select("a", "b", "n", F.greatest(F.lit(0.0), F.log(F.col("n") * F.col("all") / (F.col("of").cast("double") * F.col("of_b")))).alias("ppmi"))


def multiplied(matrix: DataFrame, factor: np.ndarray) -> np.ndarray:
    """``matrix`` (rows (a, b, ppmi), dealt and sorted by a) times ``factor``; comes back in rows of a.

    A task fills ``DENSE`` rows of the matrix at a time and multiplies them whole, so that the work is bounded by the
    square of the vocabulary, however many pairs the texts have.
    """
    sent, (size, wide) = matrix.sparkSession.sparkContext.broadcast(factor), factor.shape
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, dense = [], np.zeros((DENSE, size))

        def told():
            v = dense[: len(ids)] @ sent.value
            dense[: len(ids)] = 0
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([x.tobytes() for x in v], pa.binary())], names=schema.names)

        for batch in batches:
            a, b, x = (batch.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]).tolist() if len(a) else []
            for lo, hi in zip(starts, [*starts[1:], len(a)]):
                if not ids or ids[-1] != a[lo]:
                    if len(ids) == DENSE:
                        yield told()
                        ids = []
                    ids.append(int(a[lo]))
                dense[len(ids) - 1, b[lo:hi]] = x[lo:hi]
        if ids:
            yield told()

    got = matrix.select("a", "b", "ppmi").mapInArrow(run, schema).toArrow()  # a row per word
    out = np.zeros_like(factor)
    if got.num_rows:
        np.add.at(out, got["a"].to_numpy(), np.frombuffer(b"".join(got["v"].to_pylist())).reshape(-1, wide))  # a split file may hold a row in two parts
    sent.unpersist()
    return out


def strongest(matrix: DataFrame, size: int, length: int, seed: int = 1) -> np.ndarray:
    """``size`` rows of ``length`` numbers: the strongest directions of a symmetric matrix, each times the root of its strength."""
    wide = min(size, length + EXTRA)
    y = multiplied(matrix, np.random.default_rng(seed).normal(size=(size, wide)))
    for _ in range(SHARPEN):
        y = multiplied(matrix, np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    small = q.T @ multiplied(matrix, q)
    strength, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(strength), kind="stable")[:length]
    v = q @ turn[:, order]
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])  # either sign is right; one is chosen
    out = np.zeros((size, length))
    out[:, : len(order)] = v * np.sqrt(np.abs(strength[order]))
    return out


@dataclass(frozen=True, eq=False)
class LearnedEmbedder:
    """Texts as means of word vectors (see ``TextEmbedder``); ``counts`` are the words' occurrences among ``total``."""

    words: tuple[str, ...]
    counts: np.ndarray
    vectors: np.ndarray
    total: int

    @classmethod
    def fit(cls, texts: DataFrame, text_col: str = "text", length: int = 64, size: int = VOCABULARY, window: int = WINDOW, least: int = LEAST, seed: int = 1) -> LearnedEmbedder:
        counts = write_shared(word_counts(texts, text_col))
        words, n = vocabulary(counts, size, least)
        total = counts.agg(F.sum("n")).first()[0] or 0
        if not words:
            return cls((), n, np.zeros((0, length)), total)
        ppmi = information(write_columns(pair_counts(texts, text_col, words, window))).filter("ppmi > 0")
        matrix = write_columns(ppmi.select("a", "b", "ppmi").repartition("a").sortWithinPartitions("a", "b"))
        return cls(tuple(words), n, strongest(matrix, len(words), length, seed), total)

    @property
    def length(self) -> int:
        return self.vectors.shape[1]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(w, int(n), v.tolist(), int(self.total)) for w, n, v in zip(self.words, self.counts, self.vectors)]
        spark.createDataFrame(rows, "word string, n long, vector array<double>, total long").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LearnedEmbedder:
        rows = spark.read.parquet(path).orderBy(F.desc("n"), "word").collect()
        return cls(tuple(r.word for r in rows), np.array([r.n for r in rows]), np.array([r.vector for r in rows]), rows[0].total if rows else 0)

    def _weighted(self) -> np.ndarray:
        share = self.counts / max(1, self.total)
        return self.vectors * (HALF / (HALF + share))[:, None]

    def column(self, text: Column) -> Column:
        sent = SparkSession.active().sparkContext.broadcast((self.words, self._weighted().astype(np.float32)))
        length = self.length

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words, vectors = sent.value
            number = {w: i for i, w in enumerate(words)}
            for texts in batches:
                yield pd.Series([_mean(t, number, vectors, length) for t in texts])

        return embed(text)

    def query(self, text: str) -> np.ndarray:
        return _mean(text, {w: i for i, w in enumerate(self.words)}, self._weighted().astype(np.float32), self.length)


def _mean(text: str | None, number: dict[str, int], vectors: np.ndarray, length: int) -> np.ndarray:
    ids = [i for w in words_of(text) if (i := number.get(w)) is not None]
    if not ids:
        return np.zeros(length)
    at, times = np.unique(np.array(ids), return_counts=True)
    return l2(times.astype(float) @ vectors[at].astype(float))
