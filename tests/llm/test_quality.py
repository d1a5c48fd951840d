import random

import numpy as np
import pytest

from tesserine.llm import quality as Q


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    acc = np.array([0.9, 0.8, 0.7, 0.85, 0.75, 0.95])
    y = rng.random(20000) < 0.7
    v = np.where(rng.random((20000, 6)) < acc, y[:, None], ~y[:, None])
    silent = rng.random(v.shape) < 0.3
    keys = ["".join("-" if s else str(int(x)) for x, s in zip(a, b)) for a, b in zip(v, silent)]
    patterns = {}
    for k in keys:
        patterns[k] = patterns.get(k, 0) + 1
    share, table, posterior = Q.estimate(patterns)
    assert abs(share - 0.7) < 0.03
    assert np.allclose(table[:, 1, 1] / (table[:, 1, 0] + table[:, 1, 1]), acc, atol=0.04)
    assert np.mean([(posterior[k] > 0.5) == t for k, t in zip(keys, y)]) > 0.93


def test_looped_phrases_are_found_at_any_length():
    for size in (20, 200, 700):
        phrase = [f"word{i}x" for i in range(size)]
        for words in (2000, 6000, 20_000):
            if words >= 5 * size:
                assert Q.votes(" ".join((phrase * (words // size + 1))[:words]))[9] == "0"
                assert Q.votes(" ".join((phrase * (words // size + 1))[: words - 1]))[9] == "0"
    rng = random.Random(5)
    words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(4000)]
    for n in (20, 400, 1999, 2000, 2001, 60_000):  # many words, however often they come back in a long text
        assert Q.votes(" ".join(rng.choice(words) for _ in range(n)))[9] == "-"


def test_long_runs_are_read_whole():
    start = "山高水長" * 60
    reader = Q.Reader()
    found = [reader.read(start + end) for end in ("日月星辰" * 50, "一二三四" * 50, "日月星辰" * 50)]
    dense = np.zeros((3, Q.BUCKETS))
    for row, (_, at, x) in zip(dense, found):
        row[at] = x
    assert np.allclose(dense[0], dense[2]) and dense[0] @ dense[1] < 0.8
    near, far = reader.read("一" + start + "日月星辰" * 50), reader.read("あいうえお" * 90)
    at = np.zeros((2, Q.BUCKETS))
    at[0, near[1]], at[1, far[1]] = near[2], far[2]
    assert dense[0] @ at[0] > 0.9 and dense[0] @ at[1] < 0.3  # runs that share most of their characters are alike
    long = "Ab1-" * 51
    assert Q._shape(long + "x") != Q._shape(long) and not np.array_equal(reader.read(long + "x")[1], reader.read(long + "7")[1])


def texts(n=300):
    rng = random.Random(3)
    words = ["".join(rng.choice(["an", "er", "th", "on", "re", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(500)] + ["the", "of", "and"] * 80
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        kind = i % 5
        if kind == 0:
            t, good = " ".join(x.upper() + "!!" for x in w), False
        elif kind == 1:
            t, good = " ".join(x + rng.choice(["***", "$$$", "###"]) for x in w), False
        else:
            t, good = "\n".join(" ".join(w[j : j + 9]).capitalize() + "." for j in range(0, len(w), 9)), True
        out.append((i, t, good))
    return out


def test_scores_follow_quality(spark):
    rows = texts()
    extra = [(1000, None), (1001, ""), (1002, "one"), (None, rows[2][1]), (2, rows[2][1]), (1003, rows[2][1] * 300)]
    df = spark.createDataFrame([(i, t, 0.5, "k") for i, t, _ in rows] + [(*e, 0.1, "x") for e in extra], "doc_id long, text string, score double, votes string").repartition(3)
    got = Q.quality_scores(df).collect()
    assert len(got) == len(rows) + len(extra)
    good = {i: g for i, _, g in rows}
    known = [r for r in got if r.doc_id in good]
    assert np.mean([r.keep == good[r.doc_id] for r in known]) > 0.97
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert Q.quality_scores(df.limit(0)).count() == 0


def test_scores_equal_a_plain_model(spark):
    rows = texts(60)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    reader, patterns = Q.Reader(), {}
    read = {i: reader.read(t) for i, t, _ in rows}
    for v, *_ in read.values():
        patterns[v] = patterns.get(v, 0) + 1
    # expectation-maximisation, one document at a time
    share, table = 0.7, [[[0.4, 0.6], [0.04, 0.96]] for _ in range(10)]
    for _ in range(60):
        soft = []
        for v, *_ in read.values():
            like = [1 - share, share]
            for j, c in enumerate(v):
                if c != "-":
                    like = [like[k] * table[j][k][int(c)] for k in (0, 1)]
            soft.append(like[1] / sum(like))
        share = min(max(sum(soft) / len(soft), 1e-3), 1 - 1e-3)
        for j in range(10):
            for k in (0, 1):
                votes = [0.5, 0.5]
                for (v, *_), p in zip(read.values(), soft):
                    if v[j] != "-":
                        votes[int(v[j])] += p if k else 1 - p
                table[j][k] = [x / sum(votes) for x in votes]
    posterior = {v: p for (v, *_), p in zip(read.values(), soft)}
    # AdaGrad on soft labels
    import xxhash

    order = sorted(rows, key=lambda r: xxhash.xxh3_64_hexdigest(r[1].encode()))
    w, g2 = {}, {}
    for epoch in range(12):
        for i in np.random.default_rng(epoch).permutation(len(order)):
            v, at, x = read[order[i][0]]
            s = sum(w.get(b, 0.0) * y for b, y in zip(at.tolist(), x.tolist()))
            err = 1 / (1 + np.exp(-s)) - posterior[v]
            for b, y in zip(at.tolist(), x.tolist()):
                g = err * y + 1e-5 * w.get(b, 0.0)
                g2[b] = g2.get(b, 1e-8) + g * g
                w[b] = w.get(b, 0.0) - 0.5 * g / g2[b] ** 0.5
    for r in Q.quality_scores(df).collect():
        v, at, x = read[r.doc_id]
        s = sum(w.get(b, 0.0) * y for b, y in zip(at.tolist(), x.tolist()))
        assert r.votes == v and abs(r.posterior - posterior[v]) < 1e-6 and abs(r.score - 1 / (1 + np.exp(-s))) < 1e-3


def test_repeated_rows_stay_bounded_in_the_sample(spark):
    df = spark.createDataFrame([(5, "the same text")] * 200 + [(6, f"text {i}") for i in range(30)] + [(None, None)] * 9, "id long, text string").repartition(4)
    assert Q.fit_sample(df).count() == 32


@pytest.mark.parametrize("one", ["3L", "cast(null as bigint)"])
def test_many_texts_under_one_id_are_sampled(spark, monkeypatch, one):
    monkeypatch.setattr(Q, "FIT_ROWS", 60)
    df = spark.range(3000).selectExpr(f"{one} as id", "if(id < 2000, 'copy', concat('text ', id)) as text")
    assert Q.fit_sample(df).count() == 60
