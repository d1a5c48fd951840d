"""Word vectors from counts of neighbours, against plain NumPy."""

import math
import random
from collections import Counter

import numpy as np

from tesserine import App, IdField, Index, Query, Schema, Source, String, TextSimilaritySpace
from tesserine.functions import learned as L


def corpus(n=240, seed=2):
    rng = random.Random(seed)
    topics = [["river", "boat", "fish", "water", "bank"], ["code", "bug", "test", "build", "merge"], ["bread", "salt", "oven", "dough", "yeast"]]
    rows = []
    for i in range(n):
        words = [rng.choice(topics[i % 3]) if rng.random() < 0.8 else rng.choice(["the", "and", "of"]) for _ in range(rng.choice([4, 12, 30]))]
        rows.append((i, " ".join(words).title() if i % 5 else ", ".join(words)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "unseen-words only_here"), (n + 3, rows[0][1])]


def plain(rows, window, least):
    n, pairs = Counter(), Counter()
    texts = [L.words_of(t) for _, t in rows]
    for t in texts:
        n.update(t)
    words = sorted((w for w in n if n[w] >= least), key=lambda w: (-n[w], w))
    at = {w: i for i, w in enumerate(words)}
    for t in texts:
        for i, w in enumerate(t):
            for j in range(max(0, i - window), min(len(t), i + window + 1)):
                if i != j and w in at and t[j] in at:
                    pairs[at[w], at[t[j]]] += 1
    of, total = Counter(), sum(pairs.values())
    for (a, _), k in pairs.items():
        of[a] += k
    return words, n, pairs, {(a, b): max(0.0, math.log(k * total / (of[a] * of[b]))) for (a, b), k in pairs.items()}


def test_counts_information_and_directions_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(L, "FLUSH", 200)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, word string").repartition(4)
    words, n, pairs, ppmi = plain(rows, 3, 3)
    counts = L.word_counts(df, "text")
    assert {r.word: r.n for r in counts.collect()} == dict(n)
    got, times = L.vocabulary(counts, 100, 3)
    assert got == words and times.tolist() == [n[w] for w in words]
    found = L.information(L.pair_counts(df, "text", words, 3))
    assert {(r.a, r.b): r.n for r in found.collect()} == dict(pairs)
    assert all(abs(r.ppmi - ppmi[r.a, r.b]) < 1e-12 for r in found.collect())
    m = np.zeros((len(words), len(words)))
    for (a, b), x in ppmi.items():
        m[a, b] = x
    dealt = found.filter("ppmi > 0").repartition("a").sortWithinPartitions("a", "b")
    factor = np.random.default_rng(0).normal(size=(len(words), 5))
    assert np.allclose(L.multiplied(dealt, factor), m @ factor)
    strength, turn = np.linalg.eigh(m)
    order = np.argsort(-np.abs(strength))[:6]
    v = L.strongest(dealt, len(words), 6)
    want = turn[:, order] * np.sqrt(np.abs(strength[order]))
    assert np.allclose(v @ v.T, want @ want.T, atol=1e-6)


def test_texts_near_their_topic(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    embedder = L.LearnedEmbedder.fit(df, length=8, window=4)
    again = L.LearnedEmbedder.fit(df.repartition(5), length=8, window=4)
    assert embedder.words == again.words and np.allclose(embedder.vectors, again.vectors, atol=1e-8)
    vec = {r.id: np.array(r.v) for r in df.select("id", embedder.column(df["text"]).alias("v")).collect()}
    for i in (240, 241, 242):
        assert not vec[i].any()
    assert np.allclose(vec[0], vec[243]) and math.isclose(np.linalg.norm(vec[0]), 1)
    assert np.allclose(vec[5], embedder.query(rows[5][1]), atol=1e-6)
    near = lambda i: sorted((j for j in range(240) if j != i), key=lambda j: -vec[i] @ vec[j])[:10]
    assert np.mean([j % 3 == i % 3 for i in range(0, 240, 7) for j in near(i)]) > 0.95
    embedder.save(spark, f"{tmp_path}/words")
    stored = L.LearnedEmbedder.load(spark, f"{tmp_path}/words")
    assert stored.words == embedder.words and np.allclose(stored.vectors, embedder.vectors) and stored.total == embedder.total

    class Note(Schema):
        key: IdField
        body: String | None

    note = Note()
    space = TextSimilaritySpace(note.body, embedder)
    index = Index(space)
    app = App(spark, [source := Source(note)], [index])
    source.put([{"key": str(i), "body": t} for i, t in rows[:60]])
    best = app.query(Query(index).find(note).similar(space, "dough and salt").limit(9)).frame.collect()
    assert all(int(r.id) % 3 == 2 for r in best)


def test_a_corpus_without_words(spark):
    embedder = L.LearnedEmbedder.fit(spark.createDataFrame([(1, None), (2, "- -")], "id long, text string"), length=4)
    assert embedder.words == () and embedder.length == 4 and not embedder.query("a").any()


def test_multiplied_adds_parts_of_rows_and_works_by_rows_not_by_pairs(spark, monkeypatch):
    """Rows over several blocks and batches, and rows that a split file leaves to two tasks."""
    rng = np.random.default_rng(9)
    m = np.where(rng.random((40, 40)) < 0.6, rng.normal(size=(40, 40)), 0.0)
    m[7] = 0
    factor = rng.normal(size=(40, 6))
    rows = [(int(a), int(b), float(m[a, b])) for a, b in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, "a int, b int, ppmi double")
    monkeypatch.setattr(L, "DENSE", 3)
    whole = df.repartition(3, "a").sortWithinPartitions("a", "b")
    split = df.repartitionByRange(5, "a", "b").sortWithinPartitions("a", "b")
    for dealt in (whole, split):
        assert np.allclose(L.multiplied(dealt, factor), m @ factor, atol=1e-12)


def test_a_word_beside_itself_counts_twice_without_a_second_sum(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "b a a a")], "id long, text string")
    made = L.pair_counts(df, "text", ["a", "b"], 2)
    assert {(r.a, r.b): r.n for r in made.collect()} == {(0, 0): 8, (0, 1): 4, (1, 0): 4}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
