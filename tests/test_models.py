"""Pluggable embedders: cached text models with prompts, and images with descriptions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine import App, Blob, CachedEmbedder, IdField, ImageSpace, Index, InMemorySource, Query, Schema, SchemaError, String, TextSimilaritySpace


def letters():
    """A stand-in for a model: counts of a, b, c."""
    return lambda texts: np.array([[t.count(c) for c in "abc"] for t in texts], float)


class BlobCounts:
    """A stand-in for an image model: lengths and first bytes."""

    length = 3

    def column(self, c):
        n = F.coalesce(F.length(c), F.lit(0)).cast("double")
        return F.when(c.isNull(), F.array(*[F.lit(0.0)] * 3)).otherwise(F.array(n, F.lit(0.0), F.lit(0.0)))

    def query(self, value):
        return np.array([1.0, 0.0, 0.0])


class Note(Schema):
    id: IdField
    body: String | None
    picture: Blob | None


note = Note()
ROWS = [dict(id="1", body="aaab", picture=b"xxxx"), dict(id="2", body="ccc"), dict(id="3"), dict(id="4", body="ccc", picture=b"y")]


def run(spark, space, query):
    index = Index(space)
    source = InMemorySource(note)
    app = App(spark, [source], [index], now=0)
    source.put(ROWS)
    return {r.id: round(r.score, 6) for r in app.query(query(Query(index).find(note))).frame.collect()}


def test_cached_text_model_uses_prompts(spark):
    space = TextSimilaritySpace(note.body, embedder=CachedEmbedder(3, letters, query_prompt="cc", cache_size=1))
    got = run(spark, space, lambda q: q.similar(space, "a"))
    a, b = np.array([3, 1, 0]) / np.sqrt(10), np.array([1, 0, 2]) / np.sqrt(5)
    assert got == {"1": round(float(a @ b), 6), "2": round(2 / np.sqrt(5), 6), "4": round(2 / np.sqrt(5), 6), "3": 0.0}


def test_images_with_descriptions(spark):
    space = ImageSpace(note.picture + note.body, BlobCounts(), CachedEmbedder(3, letters))
    by_image = run(spark, space, lambda q: q.similar(space, b"z"))
    assert by_image["1"] > by_image["4"] > 0 and by_image["2"] == by_image["3"] == 0
    by_text = run(spark, space, lambda q: q.similar(space, "c"))
    assert by_text["2"] == 1.0 and by_text["4"] > by_text["1"]
    with pytest.raises(SchemaError):
        TextSimilaritySpace(note.picture)
