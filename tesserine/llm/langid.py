"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters of the lower-cased text; document frequencies
are counted over all training rows. The weights are learned by follow-the-regularised-leader with
an elastic net, which leaves most of them at exactly zero, and a temperature fitted on training
rows that the weights did not see calibrates the probabilities.

Only the fit of the weights uses a sample: the ``FIT_ROWS`` distinct rows per language with the
smallest hash of their id, for the ``MOST_LANGS`` most frequent languages. Both bounds do not
depend on the input. Everything else covers all rows and whole texts.

Defined cases: ``und`` with score 0 where the text is null or has no letter, or where nothing
could be learned; rows without a language or id-hash 0 train nothing; a null id hashes as the
empty text; repeated rows repeat in the result, count each in the document frequencies and once in
the sample; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .textops import map_texts, sized_slices, small_batches

BUCKETS = 1 << 15
#: Labelled rows per language that the weights may be fitted on; every fifth of them calibrates.
FIT_ROWS = 600
#: Languages that are learned (BUCKETS weights each on the driver and in every task).
MOST_LANGS = 256
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 4
LETTER = regex.compile(r"\p{L}")
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams (ascending) and how often each occurs."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(c), np.uint64)
    for n in range(3):
        if len(c) <= n:
            break
        h = h[: len(c) - n] * np.uint64(_MULT[n]) + c[n:]
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
        total += np.bincount((mixed >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and L2-normalised (1 + log tf) * idf values."""
    at, n = counts(text)
    x = (1 + np.log(n)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for one row of weights per class."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((classes, BUCKETS)), np.zeros((classes, BUCKETS))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = softmax(w @ x)
        g[label] -= 1
        grad = g[:, None] * x
        step = (np.sqrt(self.n[:, at] + grad * grad) - np.sqrt(self.n[:, at])) / ALPHA
        self.z[:, at] += grad - step * w
        self.n[:, at] += grad * grad


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.langs, self.weights, self.idf, self.temperature = langs, weights, idf, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0
        at, x = features(text, self.idf)
        p = softmax(self.weights[:, at] @ x / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(~held & F.col("lang").isNotNull())


def document_frequency(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training texts each bucket occurs, over all of them; ``BUCKETS`` rows at most reach the driver."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches):
        df_, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in sized_slices(batch, 0):
                for text in part.column(0).to_pylist():
                    df_[counts(text or "")[0]] += 1
                    rows += 1
        at = np.flatnonzero(df_)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df_[at], rows))], names=["bucket", "n"])

    out, total = np.zeros(BUCKETS), 0
    for bucket, n in train.select("text").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n")).collect():
        if bucket < 0:
            total = n
        else:
            out[bucket] = n
    return out, total


def fit_sample(train: DataFrame) -> DataFrame:
    """(lang, r, text): per language the first ``FIT_ROWS`` distinct rows by the hash of their id, ranked from 1."""
    keyed = train.withColumns({"h": F.xxhash64(F.col("id").cast("string")), "th": F.xxhash64("text")})
    narrow = keyed.select("lang", "id", "h", "th")
    # a share of each language that holds three times the bound on average narrows the ranking to few rows
    sizes = narrow.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("h", "th")).alias("d"))
    shares = sizes.orderBy(F.desc("n"), "lang").limit(MOST_LANGS).select("lang", (F.lit(3.0 * FIT_ROWS) / F.col("d")).alias("share"))
    near = narrow.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("h", "th"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "h", "id", "th").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "th"))
    picked = near.withColumn("r", rank).filter(F.col("r") <= FIT_ROWS).select(F.col("lang").alias("l"), F.col("id").alias("i"), F.col("th").alias("t"), "r")
    met = keyed.join(F.broadcast(picked), (F.col("lang") == F.col("l")) & F.col("id").eqNullSafe(F.col("i")) & F.col("th").eqNullSafe(F.col("t")))
    return met.groupBy("lang", "r").agg(F.first("text").alias("text"))  # repeated rows leave a task once


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    small_batches(df.sparkSession)
    train = training_rows(df, id_col, text_col, lang_col)
    freq, total = document_frequency(train)
    idf = np.log((1 + total) / (1 + freq)) + 1
    sample = fit_sample(train).select("lang", "text", "r")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("r", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch in batches:
            for part in sized_slices(batch, 1):
                got = [features(t or "", idf) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in got], pa.list_(pa.float32()))], names=schema.names)

    table = sample.mapInArrow(run, schema).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    ats, xs = [[np.asarray(v.values) for v in table[c]] for c in ("at", "x")]
    ys, ranks = [langs.index(x) for x in table["lang"].to_pylist()], table["r"].to_pylist()
    order_ = sorted(range(len(ys)), key=lambda i: (ranks[i], ys[i], len(ats[i])))
    hold = [i for i in order_ if ranks[i] % 5 == 0]
    learn = [i for i in order_ if ranks[i] % 5]
    model = Ftrl(len(langs))
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(learn)):
            model.update(ats[learn[i]], xs[learn[i]], ys[learn[i]])
    w = model.weights() if langs else np.zeros((0, BUCKETS))
    temperature = 1.0
    if hold:
        logits = np.array([w[:, ats[i]] @ xs[i] for i in hold])
        y = np.array([ys[i] for i in hold])
        grid = np.geomspace(0.05, 5, 60)
        temperature = float(min(grid, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).sum()))
    return Model(langs, w.astype(np.float32), idf, temperature)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, lang_pred, score."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages * BUCKETS weights

    def make():
        m = shared.value
        return lambda texts: list(zip(*map(m.predict, texts)))

    return map_texts(df, make, [("lang_pred", T.StringType()), ("score", T.DoubleType())], id_col, text_col)


def keep_known(df: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` whose language is recognised with a score of at least ``least``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def ok(texts):
        m = shared.value
        return texts.map(lambda t: (lambda p: p[0] != "und" and p[1] >= least)(m.predict(t)))

    return df.filter(ok(F.col(text_col).cast("string")))


def language_predictions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the training rows and predict every row: id, held_out, lang_pred, score."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return identify(df, fit(df, id_col, text_col, lang_col), id_col, text_col).select(id_col, held.alias("held_out"), "lang_pred", "score")
