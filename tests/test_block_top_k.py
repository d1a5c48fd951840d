"""Single-precision bounds: the best rows are those of doubles, also where singles cannot tell rows apart."""

import numpy as np
import pyarrow as pa
import pytest

from tesserine.plans import query as Q


def table(names, m, key):
    return pa.table([pa.array(names), pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))], names=[key, "v"])


def plain(m, v, names, k):
    s = np.round(m @ v.T, 9)
    return [(q, names[r], s[q, r]) for q in range(len(m)) for r in sorted(range(len(v)), key=lambda r: (-s[q, r], names[r]))[:k]]


def made(kind, rng):
    m, v = rng.normal(size=(70, 16)), rng.normal(size=(900, 16))
    if kind == "near":  # differences of 1e-8 at length 1, which singles do not see
        v = np.repeat(v[:3], 300, axis=0) + rng.normal(size=(900, 16)) * 1e-8
    elif kind == "copies":
        v = np.repeat(v[:2], 450, axis=0)
    elif kind == "rising":
        v = np.linspace(0.1, 9, 900)[:, None] * np.ones(16) + rng.normal(size=(900, 16)) * 1e-3
        m = np.abs(m)
    elif kind == "huge":
        v[::7] *= 1e40
    elif kind == "zeros":
        m[::3], v[::2] = 0, 0
    return m, v


@pytest.mark.parametrize("kind", ["plain", "near", "copies", "rising", "huge", "zeros"])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_equal_to_doubles(monkeypatch, kind, k):
    monkeypatch.setattr(Q, "TILE_QUERIES", 32)
    monkeypatch.setattr(Q, "TILE_ROWS", 128)
    m, v = made(kind, np.random.default_rng(2))
    names = [f"r{i * 7919 % 900}" for i in range(900)]
    got = Q.block_top_k(table(list(range(len(m))), m, "q"), table(names, v, "id"), 16, k).to_pydict()
    want = plain(m, v, names, k)
    assert list(zip(got["query_id"], got["id"])) == [w[:2] for w in want]
    assert np.allclose(got["score"], [w[2] for w in want], rtol=1e-12, atol=2e-9)


def test_singles_do_the_bulk(monkeypatch):
    """Few pairs reach double precision."""
    seen = []
    kept = Q.pair_scores
    monkeypatch.setattr(Q, "pair_scores", lambda m, v, q, row: seen.append(len(q)) or kept(m, v, q, row))
    rng = np.random.default_rng(3)
    m, v = rng.normal(size=(200, 64)), rng.normal(size=(20_000, 64))
    Q.block_top_k(table(list(range(200)), m, "q"), table([str(i) for i in range(20_000)], v, "id"), 64, 10)
    assert 0 < sum(seen) < 200 * 20_000 / 100


def test_scores_of_a_block_are_never_held_whole():
    """Numbers that a block of many queries holds: tiles, not queries times rows."""
    import tracemalloc

    rng = np.random.default_rng(6)
    asked, some = table(list(range(4096)), rng.normal(size=(4096, 64)), "q"), table([str(i) for i in range(6000)], rng.normal(size=(6000, 64)), "id")
    tracemalloc.start()
    Q.block_top_k(asked, some, 64, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
