"""Registered queries without SQL, on small tables against plain loops."""

import random

import numpy as np
import pytest

from tesserine.functions.images import GradientEmbedder
from tesserine.functions.learned import LearnedEmbedder
from tesserine.functions.text import HashedEmbedder
from tesserine.plans import catalog_search as S


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("sf")), np.random.default_rng(3)
    m = rng.normal(size=(250, 64)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(m)], "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"{path}/embeddings.parquet")
    words, pick = {"en": "the and of river boat".split(), "de": "der und von fluss boot".split()}, random.Random(1)
    docs = [(i, " ".join(pick.choice(words[g]) for _ in range(pick.randint(3, 30))), g) for i in range(202) for g in [pick.choice(["en", "de"])]] + [(202, None, "en"), (203, "the", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path, m, docs


def test_image_similar(spark, tables):
    path, m, _ = tables
    grey = np.clip(np.floor(m.astype(float) * 256 + 128), 0, 255).astype(np.uint8)
    e = GradientEmbedder()
    vectors = [e.query(b"P5 8 8 255\n" + g.tobytes()) for g in grey]
    got = {r.id: r.score for r in S.image_similar(spark, path).collect()}
    assert len(got) == 250 and all(got[str(i)] == pytest.approx(float(v @ vectors[0]), abs=2e-6) for i, v in enumerate(vectors))


def test_codes_recall(spark, tables):
    got = S.codes_recall(spark, tables[0]).collect()
    assert {r.query_id for r in got} == {0, 100, 200} and all(r.wanted == 10 for r in got)
    assert sum(r.found for r in got) >= 0.9 * 30


def test_learned_purity(spark, tables):
    path, _, docs = tables
    rows = [r for r in docs if r[1] and r[2]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in S.learned_purity(spark, path).collect():
        e = LearnedEmbedder.fit(df) if r.embedder == "learned" else HashedEmbedder(64)
        vectors = {i: e.query(t) for i, t, _ in rows}
        lang = {i: g for i, _, g in rows}
        same = []
        for q in (0, 100, 200):
            near = sorted(vectors, key=lambda i: (-round(float(vectors[i] @ vectors[q]), 9), str(i)))[:11]  # noqa: B023
            same += [lang[i] == lang[q] for i in near if i != q]
        assert r.queries == 3 and r.same_language == pytest.approx(np.mean(same), abs=0.05)
