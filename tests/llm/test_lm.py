import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesserine.llm import lm


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)


class Brute:
    """Context-tree weighting node by node."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        for t in texts:
            for ctx, s in self.symbols(t):
                for j in range(8):
                    for d in range(lm.DEPTH + 1):
                        self.n[d, ctx[lm.DEPTH - d :], (1 << j) | (s >> (8 - j))][(s >> (7 - j)) & 1] += 1
        self.kids = defaultdict(list)
        for d, ctx, p in self.n:
            if d:
                self.kids[d - 1, ctx[1:], p].append((d, ctx, p))
        self.pw = {}
        for node in sorted(self.n, key=lambda x: -x[0]):
            k = kt(*self.n[node])
            self.pw[node] = k if node[0] == lm.DEPTH else math.log(0.5) + np.logaddexp(k, sum(self.pw[c] for c in self.kids[node]))

    @staticmethod
    def symbols(t):
        raw = b"\0" * lm.DEPTH + t.encode() + b"\0"
        return [(raw[i - lm.DEPTH : i], raw[i]) for i in range(lm.DEPTH, len(raw))]

    def score(self, t):
        total = 0.0
        for ctx, s in self.symbols(t):
            for j in range(8):
                prefix, bit = (1 << j) | (s >> (8 - j)), (s >> (7 - j)) & 1
                p1, known = 0.5, False
                for d in range(lm.DEPTH, -1, -1):
                    node = (d, ctx[lm.DEPTH - d :], prefix)
                    if node in self.n:
                        n0, n1 = self.n[node]
                        w = math.exp(math.log(0.5) + kt(n0, n1) - self.pw[node]) if known else 1.0
                        p1, known = w * (n1 + 0.5) / (n0 + n1 + 1) + (1 - w) * p1, True
                total += math.log10(p1 if bit else 1 - p1)
        return total


TEXTS = ["the cat sat on the mat", "The Cat\x0bsat", None, "", "a\0b \0", "naïve café", "the the the the", "zzzz qqqq", "on the mat " * 300, "the cat sat on the mat"]


@pytest.mark.parametrize("from_file", [True, False])
def test_equals_brute_force(spark, tmp_path, monkeypatch, from_file):
    monkeypatch.setattr(lm, "GROUPED_ROWS", 50 if from_file else 100_000)
    rows = [(i, TEXTS[i % len(TEXTS)], 1.0, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, chunk string").repartition(3)
    if from_file:
        df.write.parquet(str(tmp_path / "d"))
        df = spark.read.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in lm.ctw_scores(df).collect()}
    out = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    assert 0 < len(out) < 40 and {i for i, r in got.items() if r.held_out} == out
    model = Brute([t or "" for i, t, *_ in rows if i not in out])
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + ["<end>"]
    c = Counter(w for i, t, *_ in rows if i not in out for w in words(t))
    n, v = sum(c.values()), len(c)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words(t)), sum(c[w] > 0 for w in words(t)), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)))
        assert r.score == pytest.approx(model.score(t or ""), rel=1e-5)  # values are kept as 32-bit floats


def lows(nodes):
    """Depths 0 and 1 from the nodes of depth 2."""
    ids, *values = nodes
    up = ((ids >> np.uint64(16)) << np.uint64(8)) | (ids & np.uint64(255))
    u, inv = np.unique(up, return_inverse=True)
    return lm.low_levels(u, *(np.bincount(inv, x, len(u)) for x in values))


@pytest.mark.parametrize("limit", [3, 40, 200])
def test_large_groups_are_split_by_their_next_bytes(monkeypatch, limit):
    rng = np.random.default_rng(limit)
    texts = [bytes(rng.choice(list(b"ab c"), 60).tolist()) for _ in range(40)]
    g, n = np.unique(lm.pack(texts)[0], return_counts=True)
    n = n * (rng.random(len(n)) < 0.8)
    want_nodes = lm.nodes_of(g, n)
    want = lm.log10_of(g, n, lows(want_nodes))
    monkeypatch.setattr(lm, "GROUPED_ROWS", limit)
    nodes = lm.nodes_of(g, n)
    order, same = np.argsort(nodes[0]), np.argsort(want_nodes[0])
    assert (nodes[0][order] == want_nodes[0][same]).all() and np.allclose(nodes[3][order], want_nodes[3][same])
    assert np.allclose(lm.log10_of(g, n, lows(nodes)), want, rtol=1e-5)


def test_predictions_sum_to_one():
    g, _ = lm.pack([b"abracadabra", b"alakazam"])
    seen, n = np.unique(g, return_counts=True)
    for ctx in (b"abraca", b"zzzzzz", b"\0\0\0\0\0\0", b"alakaz"):
        base = int.from_bytes(ctx[::-1][: lm.DEPTH], "big") << 8
        every = np.unique(np.concatenate([seen, np.arange(base, base + 256, dtype=np.uint64)]))
        counts = np.zeros(len(every))
        counts[np.searchsorted(every, seen)] = n
        low = lows(lm.nodes_of(every, counts))
        values = lm.log10_of(every, counts, low)
        assert (10 ** values[(every >> np.uint64(8)) == np.uint64(base >> 8)]).sum() == pytest.approx(1.0, rel=1e-5)


def test_empty_and_without_training(spark):
    df = spark.createDataFrame([(4, "x"), (15, None)], "doc_id long, text string")
    assert lm.ctw_scores(df.limit(0)).count() == 0
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = lm.ctw_scores(spark.createDataFrame([(i, "ab") for i in out], "doc_id long, text string")).collect()
    assert all(r.score == pytest.approx(24 * math.log10(0.5)) and r.train_tokens == 0 and r.n_known == 0 for r in rows)


def test_null_ids_and_very_long_texts(spark):
    df = spark.createDataFrame([(None, "some text"), (None, "some text"), (1, "a b " * 400_000), (2, None)], "doc_id long, text string")
    rows = lm.ctw_scores(df).collect()
    assert len(rows) == 4 and [r.held_out for r in rows if r.doc_id is None] == [True, True]
    long = next(r for r in rows if r.doc_id == 1)
    assert long.n_tokens == 800_001 and long.bits_per_byte < 0.1
