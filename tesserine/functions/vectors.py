"""Vector expressions over array columns of a known length.

``dot`` has three forms. ``unrolled`` is a plain sum of products that stays inside whole-stage
code generation and, over an array that is built in the same plan, folds away to its elements;
``folded`` is a higher-order function of any length; ``arrow`` multiplies whole Arrow batches with
NumPy and suits long vectors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserine.schema import SchemaError

#: Terms up to which a sum is written out; longer ones outgrow what the JIT compiles.
UNROLL = 24


def total(terms: Sequence[Column]) -> Column:
    """A balanced sum, so that long ones don't nest deeply."""
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def dot(v: Column, q: Sequence[float], strategy: str = "auto") -> Column:
    """Inner product of an array column with fixed numbers; null elements and a null array count as zeros."""
    q = [float(x) for x in q]
    if strategy == "auto":
        strategy = "unrolled" if sum(map(bool, q)) <= UNROLL else "arrow"
    if strategy == "unrolled":
        return total([F.coalesce(F.get(v, F.lit(i)).cast("double"), F.lit(0.0)) * F.lit(x) for i, x in enumerate(q) if x])
    if strategy == "folded":
        pairs = F.zip_with(v, F.array(*map(F.lit, q)), lambda a, b: F.coalesce(a.cast("double") * b, F.lit(0.0)))
        return F.coalesce(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    if strategy == "arrow":
        weights = np.array(q)

        @F.arrow_udf("double")
        def product(vectors: pa.Array) -> pa.Array:
            flat, at = vectors.flatten().fill_null(0.0).to_numpy(zero_copy_only=False), np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            out = np.zeros(len(vectors))
            if len(at) and len(flat) == len(at) * len(weights):
                out[at] = flat.reshape(-1, len(weights)) @ weights
            elif len(at):
                raise ValueError(f"vectors of length {len(weights)} are needed")
            return pa.array(out)

        return product(v.cast("array<double>"))
    raise ValueError(f"unknown strategy {strategy}")


def dot_columns(a: Column, b: Column) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm_l1(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x))


def norm_l2(v: Column, length: int | None = None) -> Column:
    """Euclidean length; written out where the number of elements is known and small."""
    if length is not None and length <= UNROLL:
        return F.sqrt(total([F.get(v, F.lit(i)).cast("double") * F.get(v, F.lit(i)).cast("double") for i in range(length)]))
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scaled(v: Column, by: Column | float) -> Column:
    by = F.lit(float(by)) if isinstance(by, (int, float)) else by
    return F.transform(v, lambda x: x.cast("double") * by)


def unit(v: Column, length: int | None = None) -> Column:
    """Divided by its Euclidean length; a zero vector stays as it is."""
    n = norm_l2(v, length)
    # the length is worked out once and repeated, not once for every element
    return F.zip_with(v, F.array_repeat(F.when(n == 0, 1.0).otherwise(n), F.size(v)), lambda x, m: x.cast("double") / m)


def part(vector: Column, offset: int, length: int) -> Column:
    return F.slice(vector, offset + 1, length)


def l2(values: np.ndarray) -> np.ndarray:
    n = math.sqrt(float((values * values).sum()))
    return values / n if n else values


def weighted_sum(items: list[tuple[np.ndarray, float]], filters: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of weighted vectors and which of its dimensions hold a negative filter.

    ``filters`` marks per vector the dimensions that hold one; they are left out of the sum. A
    dimension that sums to 0 takes its filter back; two different filters in one dimension are an
    error. Vectors of weight 0 count for nothing, and a single vector is only scaled.
    """
    masks = filters or [np.zeros(len(v), bool) for v, _ in items]
    have = [(np.asarray(v, float), w, m) for (v, w), m in zip(items, masks) if w]
    if not have:
        return np.zeros(len(items[0][0]) if items else 0), np.zeros(len(items[0][0]) if items else 0, bool)
    if len(have) == 1:
        v, w, mask = have[0]
        return np.where(mask, v, v * w), mask
    total = sum(np.where(m, 0.0, v) * w for v, w, m in have)
    marked = np.stack([m for *_, m in have])
    values = np.where(marked, np.stack([v for v, *_ in have]), np.nan)
    any_filter = marked.any(axis=0)
    low, high = (f(np.where(marked, values, start), axis=0) for f, start in ((np.min, np.inf), (np.max, -np.inf)))
    if (low[any_filter] != high[any_filter]).any():
        raise SchemaError("vectors with different negative filters in one dimension cannot be added")
    back = any_filter & (total == 0)
    return np.where(back, low, total), back
