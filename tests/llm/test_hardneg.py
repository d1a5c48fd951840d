import random
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.llm import hardneg as H

SCHEMA = "vec_id long, label int, embedding array<float>, score string, block int, rank double"


def brute(rows, anchor=lambda i: i % 10 == 0, positives=5, negatives=10):
    by_id = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not np.isfinite(x) for x in v):
            continue
        by_id[i] = min(by_id.get(i, (label, v)), (label, v))
    whole = {i: (label, [floor(256 * x) for x in v]) for i, (label, v) in by_id.items()}
    out = []
    for a, (la, va) in whole.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in whole.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2] == la][:positives]:
            window = [s for s in scored if s[2] != la and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:negatives]
            out += [(a, p, r, i, -ps, -s) for r, (s, i, _) in enumerate(window, 1)]
    return sorted(out)


def vectors(n, seed, dim=6, same=0):
    rng = random.Random(seed)
    common = [0.5, 0.25, 0.0, -0.125, 0.5, 0.5]
    return [(i, rng.randint(0, 3), [round(x, 6) for x in common] if rng.random() < same else [float(np.float32(rng.gauss(0.2, 0.4))) for _ in range(dim)]) for i in range(n)]


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, 0.0) for r in rows], SCHEMA).repartition(4)
    out = H.hard_negatives(df, F.col("id") % 10 == 0, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("same", [0, 0.4])
def test_equals_brute_force_over_many_blocks(spark, monkeypatch, same):
    """With ``same`` a vector that many rows have: ties on every side of the limits."""
    for name, value in (("BLOCK", 37), ("GROUP", 2), ("ANCHORS", 7), ("TILE", 3)):
        monkeypatch.setattr(H, name, value)
    rows = vectors(400, 1, same=same)
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 2) + [(None, 1, [1.0] * 6), (70, None, [1.0] * 6), (80, 1, None), (90, 1, [1.0, None, 1.0]), (100, 2, [nan] * 6), (101, 2, [-inf, 1.0]), (102, 2, [inf])]
    rows += rows[:5] + [(10, 0, [9.0] * 6), (10, 3, [0.0] * 6), (120, 77, [1.0] * 6), (130, 1, []), (131, 1, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, rows[:1]) == []


def test_scores_of_any_size(spark):
    rows = [(i, i % 2, [float(2 ** (10 + i % 9)), float(i), -3.0 * i]) for i in range(40)] + [(50 + i, i % 2, [float(2**22), 1.0 + i]) for i in range(4)]
    got = run(spark, rows)
    assert got == brute(rows) and max(r[4] for r in got) > H.EXACT


def test_suffix_merges_answer_overlapping_windows():
    rng = random.Random(4)
    for _ in range(200):
        found = sorted([(rng.randint(-5, 60), i) for i in range(5)], reverse=True)
        rows = sorted([(rng.randint(-60, 60), 100 + i) for i in range(40)], key=lambda r: (-r[0], r[1]))
        ends = H.limits([s for s, _ in found], 30, 90)
        slots = {j: [r for r in rows if r[0] >= ends[0] and r[0] <= top and (j + 2 == len(ends) or r[0] > ends[j + 2])][:3] for j, top in enumerate(ends[1:])}
        want = [(p, r, i, s, n) for s, p in found for r, (n, i) in enumerate([x for x in rows if 30 * s <= 100 * x[0] <= 90 * s][:3], 1)]
        assert H.answers(found, slots, 30, 90, 3) == want
