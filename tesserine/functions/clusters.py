"""k-means over a bounded sample, for cells and codebooks.

``sample_matrix`` draws the sample: rows by the hash of their id and vector, at most ``SAMPLE_ROWS`` rows
and ``SAMPLE_BYTES`` of numbers, so that what reaches the driver does not grow with the table. Only
fits use it; whatever is indexed is every row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20


def sample_matrix(df: DataFrame, length: int, id_col: str = "id", vector_col: str = "vector", seed: int = 1) -> np.ndarray:
    """Distinct rows' vectors, some ``SAMPLE_ROWS`` of them at most; all of a smaller table. Null vectors are left out."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * length)))
    rows = df.select(F.col(vector_col).cast("array<double>").alias("v"), F.xxhash64(F.col(id_col), F.col(vector_col), F.lit(seed)).alias("h")).filter("v is not null")
    n = rows.count()
    if n > most:  # what tasks hand on is bounded before it is ordered
        rows = rows.filter(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * most / n)))
    taken = rows.dropDuplicates(["h"]).orderBy("h").limit(most).select("v").toArrow()["v"].combine_chunks()
    return taken.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def nearest(points: np.ndarray, centres: np.ndarray, spherical: bool) -> np.ndarray:
    """The centre of each point: greatest inner product, or least distance."""
    s = points @ centres.T
    return (s if spherical else s - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


def k_means(points: np.ndarray, k: int, spherical: bool = False, rounds: int = 20, seed: int = 1) -> np.ndarray:
    """At most ``k`` centres; ``spherical`` ones have length 1. The same for the same input.

    Centres begin at points far from one another (k-means++); a centre without points moves to the
    point that is farthest from its own.
    """
    points = _unit(points[np.linalg.norm(points, axis=1) > 0]) if spherical else points
    points = np.asarray(points, float)
    distinct = np.unique(points, axis=0)
    if len(distinct) <= k:
        return distinct
    rng = np.random.default_rng(seed)
    far = lambda c: np.maximum(((points - c) ** 2).sum(axis=1), 0.0)
    centres = [points[rng.integers(len(points))]]
    away = far(centres[0])
    for _ in range(1, k):
        centres.append(points[min(int(np.searchsorted(np.cumsum(away), rng.random() * away.sum())), len(points) - 1)])
        away = np.minimum(away, far(centres[-1]))
    out = np.array(centres)
    for _ in range(rounds):
        own = nearest(points, out, spherical)
        sums = np.zeros_like(out)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(out))
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            new[empty] = points[np.argsort(-((points - out[own]) ** 2).sum(axis=1), kind="stable")[: len(empty)]]
        new = _unit(new) if spherical else new
        if np.allclose(new, out):
            break
        out = new
    return out
