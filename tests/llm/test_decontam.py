import itertools
import random
import re

import pytest

from tesserine.llm import decontam as D


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = {}
    for i, t in docs:
        d, found, best = tokens(t), set(), 0
        for j, u in items:
            w = tokens(u)
            if 5 <= len(w) < 11:
                if any(d[p : p + len(w)] == w for p in range(len(d))):
                    found.add(j)
                    best = max(best, len(w))
            elif len(w) >= 11:
                for diag in range(-len(w), len(d)):
                    eq = [0 <= p + diag < len(d) and d[p + diag] == w[p] for p in range(len(w))]
                    top = max(sum(eq[max(0, s) : s + 13]) for s in range(-12, len(w)))
                    if top >= 11:
                        found.add(j)
                        best = max(best, top)
        out[i] = (bool(found), len(found), ",".join(map(str, sorted(found))), best)
    return out


def test_masks_are_lossless():
    places = [{p + o for o in m} for m in D.MASKS for p in range(D.WINDOW - m[-1])]
    assert all(any(not q & set(miss) for q in places) for miss in itertools.combinations(range(D.WINDOW), D.SUBS))


@pytest.mark.parametrize("block", [100_000, 60])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_SEEDS", block)
    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([11, 12, 13, 20, 40, 5, 7, 10, 4, 1])] + [(90, None), (91, ""), (92, None)]
    docs = [(0, None), (1, ""), (2, "t1")]
    for n in range(3, 70):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        u = tokens(items[rng.randrange(10)][1])
        lo = rng.randint(0, max(0, len(u) - 13)) if rng.random() < 0.5 else 0
        part = u[lo : lo + rng.randint(9, 40)]
        for _ in range(rng.randint(0, 3)):
            part[rng.randrange(len(part))] = "changed"
        docs.append((n, " ".join(words[:20]) + " " + ", ".join(part).upper() + ". " + " ".join(words[20:])))
    docs += [(200, " ".join(rng.choice(vocab) for _ in range(30000)) + " " + items[4][1]), (3, docs[3][1])]
    want = brute(docs, items)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, best int, item string").repartition(3)
    bench = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc string")
    rows = D.contamination(df, bench).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.contaminated, r.n_items, r["items"], r.best) == want[r.doc_id], r.doc_id
    assert sum(r.contaminated for r in rows) > 15


def test_null_ids_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(None, text), (1, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert {r.doc_id: r["items"] for r in D.contamination(df, bench).collect()} == {None: "7", 1: ""}
    assert not any(r.contaminated for r in D.contamination(df, bench.limit(0)).collect())
    assert D.contamination(df.limit(0), bench).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = D.contamination(df, df.selectExpr("doc_id as item_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
