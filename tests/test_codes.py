"""Search over compressed vectors: codes, recall and the exact limit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine import SchemaError
from tesserine.operators.codes import CENTRES, Codebook, CodeIndex
from tesserine.plans.query import batch_top_k


def vectors(n=3000, length=32, seed=5):
    m = np.random.default_rng(seed).normal(size=(n, length))
    m[n // 2 : n // 2 + 300] = m[0]
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def frame(spark, m):
    return spark.createDataFrame([(f"r{i}", v.tolist()) for i, v in enumerate(m)] + [("none", None)], "id string, vector array<double>").repartition(3)


def test_scores_are_those_of_the_centres():
    m = vectors(900)
    book = Codebook.fit(m, 8)
    codes = book.encode(m)
    restored = np.concatenate([book.centres[j][codes[:, j]] for j in range(8)], axis=1)
    assert codes.max() < CENTRES and np.allclose(book.scores(m[:7], codes), m[:7] @ restored.T)
    size = m.shape[1] // 8
    far = lambda j, c: ((m[:, j * size : (j + 1) * size] - book.centres[j][c]) ** 2).sum(axis=1)
    assert all((far(j, codes[:, j]) <= far(j, np.full(len(m), c)) + 1e-9).all() for j in range(8) for c in range(0, CENTRES, 50))
    with pytest.raises(SchemaError, match="equal parts"):
        Codebook.fit(m, 5)


def test_recall_and_exact_limit(spark):
    m = vectors()
    df = frame(spark, m)
    asked = df.filter("id rlike '^r[0-9]*00$'").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    index = CodeIndex.build(df, 32, parts=8)
    found = index.recall(asked, 10).collect()
    assert len(found) == 29 and all(r.wanted == 10 for r in found)
    assert sum(r.found for r in found) / sum(r.wanted for r in found) >= 0.9
    rows = lambda d: sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in d.collect())
    exact = rows(batch_top_k(df, asked, 32, 10))
    assert rows(index.search(asked, 10, candidates=3000)) == exact
    again = CodeIndex.open(spark, index.path)
    assert np.array_equal(again.book.centres, index.book.centres) and again.length == 32
    scan = index.rows().select("id", "code")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:string,code:array<smallint>>" in scan  # vectors stay unread


def test_batches_equal_brute_force_with_ties(spark):
    m = np.round(vectors(700, 4), 1)
    df = frame(spark, m)
    asked = df.filter("id in ('r0', 'r7', 'none')").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got = sorted((r.query_id, r.rank, r.id) for r in batch_top_k(df, asked, 4, 25).collect())
    want = []
    for q in ("r0", "r7"):
        s = np.round(m @ m[int(q[1:])], 9)
        want += [(q, k + 1, n) for k, (_, n) in enumerate(sorted((-x, f"r{i}") for i, x in enumerate(s))[:25])]
    assert got == sorted(want)
    assert CodeIndex.build(df.limit(0), 4, parts=2).search(asked, 3).count() == 0
