import random

import numpy as np

from tesserine.llm import langid as L


def corpus(n=240):
    rng = random.Random(2)
    alphabet = {"aa": "the and of ing er tion".split(), "bb": "der die und sch ung ich".split(), "cc": "le la que eau oux é".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(alphabet))
        text = " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))
        rows.append((i, text, lang if rng.random() < 0.9 else None, lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    extra = [(1000, None, "aa", "und"), (1001, "", "bb", "und"), (1002, "123 !? 456", "aa", "und"), (None, "der die und schung", None, "bb"), (1003, "the and " * 60000, "aa", "aa")]
    df = spark.createDataFrame([(*r[:3], "x", 0.5) for r in rows + extra], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    got = L.language_predictions(df).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {r[0]: r[3] for r in rows + extra}
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id is None or r.doc_id >= 1000)
    assert all(0 <= r.score <= 1 for r in got)


def test_training_ignores_held_out_rows_and_is_sparse(spark):
    import zlib

    rows = corpus()
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    model = L.fit(df)
    wrong = spark.createDataFrame([(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else g) for i, t, g, _ in rows], df.schema)
    other = L.fit(wrong)
    assert model.langs == other.langs == ["aa", "bb", "cc"] and np.array_equal(model.weights, other.weights)
    assert (model.weights != 0).mean() < 0.2
    assert L.keep_known(df, model, 0.4).count() > 230


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.language_predictions(df).collect()} == {"und"}
    assert L.language_predictions(df.limit(0)).count() == 0


def plain_features(text, df, total):
    """Hashed n-grams one by one, and their TF-IDF."""
    mask, c = (1 << 64) - 1, [ord(x) for x in " " + text.lower() + " "]
    tf = {}
    for n in range(1, 4):
        for i in range(len(c) - n + 1):
            h = 0
            for k in range(n):
                h = (h * L._MULT[k] + c[i + k]) & mask
            mixed = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 + n - 1) & mask
            tf[mixed >> 49] = tf.get(mixed >> 49, 0) + 1
    if df is None:
        return tf
    x = {b: (1 + np.log(f)) * (np.log((1 + total) / (1 + df.get(b, 0))) + 1) for b, f in tf.items()}
    norm = sum(v * v for v in x.values()) ** 0.5
    return {b: v / norm for b, v in x.items()}


def test_equals_plain_training_and_prediction(spark):
    import zlib

    rows = corpus(90)
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    train = [(i, t, g) for i, t, g, _ in rows if g and zlib.crc32(str(i).encode()) % 5]
    freq = {}
    for _, t, _ in train:
        for b in plain_features(t, None, 0):
            freq[b] = freq.get(b, 0) + 1
    ranked = {(r.lang, r.text): r.r for r in L.fit_sample(L.training_rows(df, "doc_id", "text", "lang")).collect()}
    assert len(ranked) == len({(g, t) for _, t, g in train})
    langs = sorted({g for *_, g in train})
    order = sorted(((ranked[g, t], langs.index(g), plain_features(t, freq, len(train))) for _, t, g in train), key=lambda r: r[:2])
    learn, hold = [r for r in order if r[0] % 5], [r for r in order if r[0] % 5 == 0]
    z, n = [{} for _ in langs], [{} for _ in langs]

    def weight(k, b):
        zz, nn = z[k].get(b, 0.0), n[k].get(b, 0.0)
        return 0.0 if abs(zz) <= L.L1 else (np.sign(zz) * L.L1 - zz) / ((L.BETA + nn**0.5) / L.ALPHA + L.L2)

    def chances(x, temperature=1.0):
        s = np.array([sum(weight(k, b) * v for b, v in x.items()) for k in range(len(langs))]) / temperature
        e = np.exp(s - s.max())
        return e / e.sum()

    for epoch in range(L.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(learn)):
            _, y, x = learn[i]
            p = chances(x)
            for k in range(len(langs)):
                for b, v in x.items():
                    g, old, w = (p[k] - (k == y)) * v, n[k].get(b, 0.0), weight(k, b)
                    z[k][b] = z[k].get(b, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / L.ALPHA * w
                    n[k][b] = old + g * g
    loss = lambda t: -sum(np.log(chances(x, t)[y] + 1e-12) for _, y, x in hold)
    best = min(np.geomspace(0.05, 5, 60), key=loss)
    got = {r.doc_id: r for r in L.language_predictions(df).collect()}
    for i, t, *_ in rows:
        p = chances(plain_features(t, freq, len(train)), best)
        assert got[i].lang_pred == langs[int(p.argmax())] and abs(got[i].score - p.max()) < 2e-3


def test_repeated_rows_stay_bounded_in_the_sample(spark):
    rows = corpus(40)
    same = [(7777, "der die und schung", "bb")] * 300 + [(8888, f"the and of {i}", "aa") for i in range(50)]
    df = spark.createDataFrame([r[:3] for r in rows] + same, "doc_id long, text string, lang string").repartition(4)
    train = L.training_rows(df, "doc_id", "text", "lang")
    got = L.fit_sample(train)
    assert got.count() == train.distinct().count() and got.select("lang", "r").distinct().count() == got.count()
    assert L.language_predictions(df).count() == df.count()


def test_many_texts_under_one_id_keep_their_languages(spark, monkeypatch):
    monkeypatch.setattr(L, "FIT_ROWS", 40)
    parts = {"aa": "the of ing", "bb": "der die sch", "cc": "le les que"}
    rows = [(1, f"{p} {i} {p[: i % 5]} {i * 7}", g) for g, p in parts.items() for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert {r.lang: r.n for r in L.fit_sample(L.training_rows(df, "doc_id", "text", "lang")).groupBy("lang").count().withColumnRenamed("count", "n").collect()} == dict.fromkeys(parts, 40)
    got = L.language_predictions(df).groupBy("lang_pred").count().collect()
    assert {r.lang_pred for r in got} == set(parts)
