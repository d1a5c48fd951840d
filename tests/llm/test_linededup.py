import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesserine.llm import linededup as L

SCHEMA = "doc_id long, text string, n_lines string, kept_text int, high int, shard int"


def brute(rows, least=40, docs=5):
    lower = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(" \t\n\v\f\r").translate(lower)
    low = lambda i: -(1 << 63) if i is None else i
    times, last = Counter(), defaultdict(lambda: -(1 << 63))
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                times[k] += 1
                last[k] = max(last[k], low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (times[key(x)] >= docs and last[key(x)] != low(i))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def corpus(seed=3):
    rng = random.Random(seed)
    shared = [f"Shared Line {i} {'x' * rng.randint(25, 40)}" for i in range(60)] + ["é" * 40, "é" * 39, " " + "w" * 40, "İ" * 41]
    rows = []
    for i in range(300):
        lines = [rng.choice(shared[: rng.choice([5, 64])]) if rng.random() < 0.6 else f"own {i} {rng.random()} {'y' * 30}" for _ in range(rng.choice([0, 1, 3, 30]))]
        rows.append((i, "\n".join(rng.choice(["", " ", "\t\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " \f", "\r"]) for x in lines)))
    rows += [(None, None), (None, ""), (None, shared[0]), (None, shared[0] + "\n" + shared[0]), (17, shared[0]), (299, shared[0] + "\n\n")]
    rows += [(299, shared[0] + "\n\n")] * 2 + [(None, "only among nameless rows " + "z" * 30)] * 6
    rows.append((1000, "\n".join(["long " * 100_000, shared[1], "k" * 40] * 2)))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("here", [True, False])
def test_equals_brute_force(spark, monkeypatch, here):
    monkeypatch.setattr(L, "SHARD_KEYS", 8)
    monkeypatch.setattr(L, "SALT_PROBES", 60)
    if not here:
        monkeypatch.setattr(L, "BROADCAST_KEYS", 0)
    rows = corpus()
    got = L.line_digests(frame(spark, rows))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows)
    texts = {r.doc_id: r.kept_text for r in L.dedup_lines(frame(spark, rows[:40])).collect()}
    assert len(texts) and all(t is not None for t in texts.values())


def test_empty_tables_and_no_frequent_lines(spark, monkeypatch):
    assert L.line_digests(frame(spark, []).limit(0)).count() == 0
    rows = [(1, "a"), (2, None), (3, "b" * 50)]
    assert Counter(map(tuple, L.line_digests(frame(spark, rows)).collect())) == brute(rows)
    monkeypatch.setattr(L, "BROADCAST_KEYS", -1)
    assert Counter(map(tuple, L.line_digests(frame(spark, rows)).collect())) == brute(rows)


def test_perfect_hash_gives_each_key_a_place_of_its_own():
    rng = np.random.default_rng(5)
    high, low = rng.integers(0, 1 << 64, (2, 30_000), np.uint64)
    high[:50] = high[0]  # equal first halves part by their second
    total, n, last = 4, rng.integers(5, 1 << 40, 30_000), rng.integers(-(1 << 60), 1 << 60, 30_000)
    which = L.shard_of(high, total)
    index = L.LineIndex([L.build_shard(high[which == k], low[which == k], n[which == k], last[which == k]) for k in range(total)])
    at = index.find(high, low)
    assert sorted(at.tolist()) == list(range(30_000))  # minimal and perfect
    assert (index.lasts[at] == last).all() and (index.counts[at] == np.minimum(n, 0xFFFFFFFF)).all()
    assert len(index.words) * 64 < 5 * 30_000
    assert (index.find(*rng.integers(0, 1 << 64, (2, 30_000), np.uint64)) == -1).all()
    assert (L.LineIndex([]).find(high[:3], low[:3]) == -1).all()
    with pytest.raises(ValueError, match="distinct"):
        L.build_shard(high[[0, 0]], low[[0, 0]], n[:2], last[:2])
