import random
import re

import numpy as np

from tesserine.llm import neardup as N


def word_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent=80):
    sets = [(i, word_set(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, sa) in enumerate(sets):
        for b, sb in sets[n + 1 :]:
            if sa and sb and None not in (a, b) and 100 * len(sa & sb) >= percent * len(sa | sb):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets if i is not None}


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "one two", "One TWO", "a b c d", "É é", "É É", "lone"]
    for _ in range(25):
        words = [rng.choice(vocab) for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(rng.choice([1, 2, 12])):  # copies with some words changed: similarities on both sides of the threshold
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    chain = [rng.choice(vocab) for _ in range(200)]
    for _ in range(12):  # a chain of which only neighbours are near
        texts.append(" ".join(chain))
        chain = chain[9:] + [rng.choice(vocab) for _ in range(9)]
    texts.append("long " + " ".join(rng.choice(vocab) for _ in range(50000)))
    rng.shuffle(texts)
    return list(enumerate(texts + texts[:5]))


def test_equals_brute_force(spark):
    rows = corpus()
    for k in (4, 5):
        want = brute(rows, k)
        df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, kept string, component_id int").repartition(3)
        got = {r.doc_id: r for r in N.near_duplicates(df, words=k).collect()}
        assert len(got) == len(rows)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    """Without star links only the block comparison can join the components."""
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "_verified", lambda pairs, *a: pairs.limit(0))
    base = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join(base[:99] + [f"t{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in N.near_duplicates(df).collect()} == {0}


def test_null_ids_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "other words here now and then"), (None, "alone in this text today ok"), (9, None)], schema)
    got = sorted(((r.doc_id or -1), r.component_id or -1, r.kept) for r in N.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, 5, False), (5, 5, True), (5, 5, True), (7, 7, True), (9, 9, True)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_thresholds_follow_the_posterior():
    least = N.min_matches(0.8)
    assert len(least) == 4 and all(0 < m < 26 * (i + 1) for i, m in enumerate(least))
    rng = np.random.default_rng(0)
    same = rng.random((2000, 128)) < 0.8
    a = np.zeros((2000, 128), np.uint32)
    assert len(N.sequential(a, np.where(same, 0, 1).astype(np.uint32), least)) == 2000
    assert len(N.sequential(a, (rng.random((2000, 128)) > 0.3).astype(np.uint32), least)) == 0
