"""Texts are decoded a slice at a time: what a task holds does not grow with an Arrow batch."""

import numpy as np
import pyarrow as pa

from tesserine.functions import text as X


def test_slices_are_bounded_and_whole():
    texts = pa.array([None, "", *["word " * 4000] * 1000, *["x"] * 5000, "y" * (5 << 20), None])
    sizes = [(len(s), sum(len(t.as_py() or "") for t in s)) for s in X.text_slices(texts)]
    assert sum(n for n, _ in sizes) == len(texts) and max(n for n, _ in sizes) <= X.SLICE_TEXTS
    assert all(b <= X.SLICE_BYTES or n == 1 for n, b in sizes)
    assert pa.concat_arrays(list(X.text_slices(texts))).equals(texts)
    assert not list(X.text_slices(pa.array([], pa.string())))


def test_columns_equal_the_plain_functions(spark, monkeypatch):
    """A batch of many slices, null and blank texts among them; the words kept are let go meanwhile."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, None if i % 50 == 0 else " ".join(rng.choice(words, rng.integers(0, 900))) + ". end") for i in range(2500)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    embedder = X.HashedEmbedder(16)
    got = df.select("id", embedder.column(df.text).alias("v"), X.chunk_column(df.text, size=200).alias("c")).collect()
    assert len(got) == len(rows) and sum(len(t or "") for _, t in rows) > 2 * X.SLICE_BYTES
    want = dict(rows)
    for r in got:
        assert np.allclose(r.v, embedder.query(want[r.id])) and r.c == X.chunk_text(want[r.id], size=200)
