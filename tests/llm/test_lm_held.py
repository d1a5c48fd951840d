"""What a task gathers at a time is bounded; handing it on in parts changes no score."""

import random

import pytest

from tesserine.llm import lm


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(i, None if i == 3 else " ".join(rng.choice(["tree", "context", "Weight", "Bytes", "x" + str(rng.randint(0, 400))]) for _ in range(rng.randint(0, 60)))) for i in range(600)]
    path = str(tmp_path_factory.mktemp("held"))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_parts_give_the_same_scores(docs, monkeypatch):
    want = {r.doc_id: r for r in lm.ctw_scores(docs).collect()}
    monkeypatch.setattr(lm, "sized_slices", lambda batch, column, *_: (batch.slice(i, 50) for i in range(0, batch.num_rows, 50)))
    monkeypatch.setattr(lm, "HELD_GRAMS", 500)
    monkeypatch.setattr(lm, "HELD_WORDS", 40)
    parts = lm.gathered(lm.with_chunks(docs, "doc_id", "text"))
    most = parts.filter("pair >= 0").groupBy("chunk", "pair").count().agg({"count": "max"}).first()[0]
    assert most > 1  # a chunk was handed on in parts
    got = {r.doc_id: r for r in lm.ctw_scores(docs).collect()}
    assert set(got) == set(want) == set(range(600))
    for i, r in want.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (r.held_out, r.n_tokens, r.n_known, r.train_tokens)
        assert got[i].base_score == pytest.approx(r.base_score, abs=1e-9) and got[i].score == pytest.approx(r.score, abs=1e-5)


def test_chunks_of_a_split(docs):
    """A whole file split makes chunks of 16 MB of input at most."""
    assert lm.with_chunks(docs, "doc_id", "text").select("chunk").distinct().count() == (128 << 20) // (16 << 20)
