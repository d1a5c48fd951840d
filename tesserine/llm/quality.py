"""Document quality without labels: heuristic labellers, their accuracies by EM, a hashed linear scorer.

Ten labellers vote good, bad or nothing on each text. How often each pattern of votes occurs is
counted over all documents (at most 3^10 patterns, the product of the labellers' outcomes);
expectation-maximisation over these counts estimates the labellers' accuracies and the share of
good documents. The posterior of each document's pattern is the soft label from which a linear
model over hashed words and word shapes learns, so that the score no longer depends on the
heuristics alone. Runs of more than ``LONG`` characters without a blank (scripts written without
blanks, encoded data) also give their character trigrams.

Only the fit of the linear model uses a sample: the ``FIT_ROWS`` distinct rows with the smallest
hash of their id.

Defined cases: a null text counts as empty; empty texts get the votes of an empty text; without
bad (or good) votes anywhere the posterior is the estimated share alone; repeated rows repeat; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import hash_share, map_texts, sized_slices

BUCKETS = 1 << 14
FIT_ROWS = 4_000
KEEP = 0.5
LONG = 64
#: Words of a window in which a longer text's distinct words are counted.
WINDOW = 500

#: Frequent short words of four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in is it that for on with as was at by this are be from or an".split()
    + "der die und das von mit ist im zu den auf für ein eine nicht des dem".split()
    + "le la les de des et un une du en que qui dans pour sur au aux par elle il".split()
    + "el los las y en un una por para con del se su no es al lo".split()
)
LETTERS = re.compile(r"[^\W\d_]+")
NUMBER, REPEATED = re.compile(r"\d+"), re.compile(r"(\W)\1+")
EDGE = re.compile(r"[#$%&*~^=<>|!]{1,}$")


def _case(letters: str) -> str:
    return "a" if letters.islower() else "A" if letters.isupper() else "Aa" if letters[1:].islower() else "m"


def _shape(word: str) -> str:
    """Runs of letters by their case, digits as one 0, repeated signs once."""
    return REPEATED.sub(r"\1", NUMBER.sub("0", LETTERS.sub(lambda m: _case(m[0]), word)))


def looped(ids: np.ndarray, share: float = 0.3) -> bool:
    """Whether windows of ``WINDOW`` words hold less than ``share`` distinct words on average, or the text less than that of distinct runs of five words.

    Neither falls as an ordinary text gets longer; the runs find loops that are longer than a window.
    """
    n = len(ids)
    starts = [*range(0, n - WINDOW, WINDOW), n - WINDOW]
    keys = np.sort(np.stack([ids[a : a + WINDOW] for a in starts]), axis=1)
    if (len(starts) + int((keys[:, 1:] != keys[:, :-1]).sum())) < share * keys.size:
        return True
    runs = np.zeros(n - 4, np.uint64)
    for i in range(5):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + ids[i : n - 4 + i].astype(np.uint64) + np.uint64(1)
    return len(np.unique(runs)) < share * len(runs)


def trigrams(word: str) -> np.ndarray:
    """Buckets of all character trigrams."""
    c = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = (c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


class Reader:
    """Votes and hashed features of texts; what a word contributes is worked out once and kept.

    A row of ``flags`` holds a word's edge sign, lack of letters and digits, place among the function
    words, letters and capitals; a row of ``at`` the buckets of the word and of its shape; ``long`` the
    words whose trigrams count too.
    """

    KEPT = 600_000

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        self.long: dict[int, str] = {}
        self.flags, self.at = np.zeros((1024, 5)), np.zeros((1024, 2), np.int64)

    def _add(self, word: str) -> None:
        i = self.rows[word] = len(self.rows)
        if i == len(self.flags):
            self.flags, self.at = np.concatenate([self.flags, np.zeros_like(self.flags)]), np.concatenate([self.at, np.zeros_like(self.at)])
        low = word.islower()
        if word.isalpha():  # most words
            letters, edge, alone, shape = len(word), False, False, _case(word)
        else:
            letters, edge = sum(map(len, LETTERS.findall(word))), len(word) > 1 and EDGE.search(word) is not None
            alone, shape = not letters and not any(map(str.isalnum, word)), _shape(word)
        upper = 0 if low else sum(map(str.isupper, word))
        self.flags[i] = edge, alone, (word if low else word.lower()).strip(".,;:!?") in FUNCTION_WORDS, letters, upper
        if shape not in self.shapes:
            self.shapes[shape] = xxhash.xxh3_64_intdigest(("s" + shape).encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1
        self.at[i] = xxhash.xxh3_64_intdigest(("w" + word).encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1, self.shapes[shape]
        if len(word) > LONG:
            self.long[i] = word

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > self.KEPT:
            self.rows.clear()
            self.shapes.clear()
            self.long.clear()
        for w in set(words).difference(self.rows):
            self._add(w)
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def read(self, text: str | None, features: bool = True) -> tuple[str, np.ndarray | None, np.ndarray | None]:
        """Votes, buckets and L2-normalised square roots of the counts of hashed words and shapes."""
        text = text or ""
        words = text.split()
        ids = self._ids(words)
        each, times = np.unique(ids, return_counts=True)
        found = self.votes(text, ids, each, times)
        if not features:
            return found, None, None
        total = np.bincount(self.at[each].ravel(), np.repeat(times, 2), BUCKETS) if len(each) else np.zeros(BUCKETS)
        if self.long:
            for i in set(each.tolist()).intersection(self.long):
                total += np.bincount(trigrams(self.long[i]), minlength=BUCKETS) * times[np.searchsorted(each, i)]
        total[0] = 1.0
        at = np.flatnonzero(total)
        x = np.sqrt(total[at])
        return found, at, x / np.sqrt((x * x).sum())

    def votes(self, text: str, ids: np.ndarray, each: np.ndarray, times: np.ndarray) -> str:
        """One character per labeller: 1 good, 0 bad, - nothing."""
        n = len(ids)
        if not n:
            return "0" + "-" * 9
        edge, alone, known, letters, upper = times @ self.flags[each] / n
        lines = [x for x in text.split("\n") if x and not x.isspace()]
        ends = sum(x.rstrip()[-1] in ".!?\"'»”" for x in lines) / len(lines)
        many, caps, top, again = n >= 20, upper / max(1 / n, letters), times.max() / n, int((ids[1:] == ids[:-1]).sum()) / n
        held = len(set(lines)) / len(lines) if len(lines) > 3 else None

        def vote(bad: bool, good: bool) -> str:
            return "0" if bad else "1" if good else "-"

        return "".join([
            vote(n < 3, n >= 40),
            vote(caps > 0.4, caps < 0.15),
            vote(edge > 0.25, edge < 0.05),
            vote(alone > 0.2, alone < 0.05),
            vote(many and known < 0.02, known > 0.1),
            vote(many and (top > 0.25 or again > 0.2), many and top < 0.15 and again < 0.05),
            vote(many and not ends, ends > 0.5),
            vote(not 2 < letters < 14, 3 < letters < 9),
            vote(held is not None and held < 0.6, held is not None and held > 0.95),
            vote(many and len(each) < 0.3 * n and (n <= WINDOW or looped(ids)), False),
        ])


def votes(text: str | None) -> str:
    return Reader().read(text, features=False)[0]


def estimate(patterns: dict[str, int], rounds: int = 60) -> tuple[float, np.ndarray, dict[str, float]]:
    """EM over counted vote patterns: share of good documents, P(vote | class) per labeller, posterior of good per pattern."""
    if not patterns:
        return 0.5, np.zeros((0, 2, 3)), {}
    keys = sorted(patterns)
    count = np.array([patterns[k] for k in keys], float)
    seen = np.array([["01-".index(c) for c in k] for k in keys])
    m = seen.shape[1]
    share = 0.7
    # a labeller that calls a text bad starts out as the stronger evidence; silence is none
    table = np.tile(np.array([[0.4, 0.6, 1.0], [0.04, 0.96, 1.0]]), (m, 1, 1))
    for _ in range(rounds):
        logs = np.log([1 - share, share]) + np.log(table[np.arange(m), :, seen]).sum(axis=1)
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        weight = np.stack([count * (1 - post), count * post])
        share = float(np.clip(weight[1].sum() / count.sum(), 1e-3, 1 - 1e-3))
        for j in range(m):
            for c in (0, 1):
                votes_ = np.bincount(seen[:, j], weight[c], 3)[:2] + 0.5
                table[j, c, :2] = votes_ / votes_.sum()
    return share, table, dict(zip(keys, post.tolist()))


def learn(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, epochs: int = 12, rate: float = 0.5, ridge: float = 1e-5) -> np.ndarray:
    """Weights of a logistic model on soft labels, by AdaGrad."""
    w, g2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = rows[i]
            g = (1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30))) - soft[i]) * x + ridge * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


def vote_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id and the labellers' votes."""


    def make():
        reader = Reader()
        return lambda texts: [[reader.read(t, features=False)[0] for t in texts]]

    return map_texts(df, make, [("votes", T.StringType())], id_col, text_col)


def fit_sample(texts: DataFrame) -> DataFrame:
    """(id, text): ``FIT_ROWS`` distinct rows of ``texts``, those with the smallest hash of their id."""
    keyed = hash_share(texts, ["id", "text"], FIT_ROWS, 7).withColumns({"h": F.xxhash64(F.col("id").cast("string"), F.lit(7)), "th": F.xxhash64("text")})
    picked = keyed.select("h", "id", "th").distinct().orderBy("h", "id", "th").limit(FIT_ROWS).select(F.col("id").alias("i"), F.col("th").alias("t"))
    met = keyed.join(F.broadcast(picked), F.col("id").eqNullSafe(F.col("i")) & F.col("th").eqNullSafe(F.col("t")))
    return met.groupBy("id", "th").agg(F.first("text").alias("text")).select("id", "text")  # repeated rows leave a task once


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], np.ndarray]:
    """Posterior of every vote pattern of the corpus, and the weights learned from them."""
    found = vote_table(df, id_col, text_col)
    patterns = {r.votes: r.n for r in found.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3^10 rows
    _, _, posterior = estimate(patterns)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = fit_sample(texts)
    schema = T.StructType([T.StructField("h", T.StringType()), T.StructField("votes", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches):
        reader = Reader()
        for batch in batches:
            for part in sized_slices(batch, 1):
                texts = part.column(1).to_pylist()
                got = [reader.read(t) for t in texts]
                keys = [f"{xxhash.xxh3_64_hexdigest((t or '').encode('utf-8', 'surrogatepass'))}" for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([v for v, _, _ in got]), pa.array([a.astype(np.int32) for _, a, _ in got], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, _, x in got], pa.list_(pa.float32()))], names=schema.names)

    table = sample.mapInArrow(run, schema).toArrow()
    order_ = np.argsort(np.array(table["h"].to_pylist(), dtype=str), kind="stable")[:FIT_ROWS]
    at, x, v = table["at"], table["x"], table["votes"].to_pylist()
    rows = [(np.asarray(at[int(i)].values), np.asarray(x[int(i)].values)) for i in order_]
    return posterior, learn(rows, np.array([posterior[v[int(i)]] for i in order_]))


def quality_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, votes, posterior (of the labellers), score (of the linear model) and keep."""
    shared = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col))  # 3^10 posteriors and BUCKETS weights at most

    def make():
        posterior, w = shared.value
        reader = Reader()

        def one(text):
            v, at, x = reader.read(text)
            score = float(1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30))))
            return v, posterior[v], score, score >= KEEP

        return lambda texts: list(zip(*map(one, texts)))

    return map_texts(df, make, [("votes", T.StringType()), ("posterior", T.DoubleType()), ("score", T.DoubleType()), ("keep", T.BooleanType())], id_col, text_col)
