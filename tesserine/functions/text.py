"""Text functions: a hashed embedder that needs no model, the embedder protocol, and the chunker."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from itertools import accumulate
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.vectors import l2

WORD = re.compile(r"[a-z0-9]+")


#: Bytes of text, and texts, that a task decodes at a time; words whose slots it keeps.
SLICE_BYTES, SLICE_TEXTS, KEPT_WORDS = 2 << 20, 2000, 1 << 16


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive slices of about ``SLICE_BYTES`` (one text at least), whatever the size of an Arrow batch."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > SLICE_BYTES or i - start >= SLICE_TEXTS):
            yield texts.slice(start, i - start)
            start = i
            held = 0
        held += n
    if len(texts) > start:
        yield texts.slice(start)


class TextEmbedder(Protocol):
    """Anything that turns a text column into vectors of ``length``; queries may use a prompt of their own."""

    length: int

    def column(self, text: Column) -> Column: ...

    def query(self, text: str) -> np.ndarray: ...


class HashedEmbedder:
    """Signed counts of hashed lower-case words (ASCII letters and digits), L2-normalised.

    Bucket and sign of a word come from its MD5, so that other engines can follow. Null and texts
    without words give zeros. Runs over slices of Arrow batches; the slots of words are kept between texts.
    """

    def __init__(self, length: int = 128):
        self.length = length

    def slot(self, word: str) -> int:
        """Twice the bucket, and one more for words that count down."""
        h = hashlib.md5(word.encode()).hexdigest()
        return int(h[:8], 16) % self.length * 2 + (int(h[8], 16) >= 8)

    def counts(self, text: str | None, kept: dict) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for w in set(words).difference(kept):
            kept[w] = self.slot(w)
        up_down = np.bincount(np.fromiter(map(kept.__getitem__, words), np.int64, len(words)), minlength=2 * self.length)
        return l2((up_down[::2] - up_down[1::2]).astype(float))

    def column(self, text: Column) -> Column:
        counts, length = self.counts, self.length

        @F.arrow_udf("array<double>")
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            kept: dict = {}
            for texts in batches:
                for some in text_slices(texts):
                    m = np.empty((len(some), length))
                    for i, t in enumerate(some):
                        m[i] = counts(t.as_py(), kept)
                    yield pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, length, dtype=np.int32)), pa.array(m.ravel()))

        return embed(text)

    def query(self, text: str) -> np.ndarray:
        return self.counts(text, {})


class CachedEmbedder:
    """An embedder for models: texts of a batch are embedded once each, and the last ones are kept.

    ``load`` runs once per task and returns a function from a list of texts to a matrix.
    """

    def __init__(self, length: int, load, query_prompt: str = "", document_prompt: str = "", cache_size: int = 10_000):
        self.length, self.load, self.query_prompt, self.document_prompt, self.cache_size = length, load, query_prompt, document_prompt, cache_size

    def column(self, text: Column) -> Column:
        load, prompt, size, length = self.load, self.document_prompt, self.cache_size, self.length

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model, kept = load(), OrderedDict()
            for texts in batches:
                new = [t for t in dict.fromkeys(texts) if t and t not in kept]
                fresh = dict(zip(new, (l2(np.asarray(v, float)) for v in model([prompt + t for t in new])))) if new else {}
                yield pd.Series([fresh.get(t, kept.get(t, np.zeros(length))) if t else np.zeros(length) for t in texts])
                kept.update(fresh)
                while len(kept) > size:
                    kept.popitem(last=False)

        return embed(text)

    def query(self, text: str) -> np.ndarray:
        return l2(np.asarray(self.load()([self.query_prompt + text])[0], float))


BLANKS = re.compile(r"[ \t\n\r\f\v]+")


def cuts(flat: str, size: int, separators: list[str]) -> list[int]:
    """Offsets at which a text is cut into pieces, its two ends among them.

    A cut lies behind an occurrence of a separator and the blank after it. Separators count in the
    order given, each inside those pieces only that are still longer than ``size``.
    """
    ends = np.array([0, len(flat)])
    for sep in separators:
        behind = np.array([m.end() for m in re.finditer(re.escape(sep) + " ?", flat)], np.int64)
        piece = np.searchsorted(ends, behind)
        ends = np.union1d(ends, behind[np.diff(ends)[np.maximum(piece, 1) - 1] > size])
    return ends.tolist()


def chunk_text(text: str | None, size: int = 250, overlap: int = 20, kept: list[str] | None = None, removed: list[str] | None = None) -> list[str]:
    """Chunks of at most ``size`` characters where separators allow it.

    Blanks are squeezed. A text that fits is one chunk. A longer one is cut at ``removed`` separators
    (which are left out), then at ``kept`` ones, then at blanks (see ``cuts``). A chunk takes pieces as
    long as they fit, one at least; the next begins with the last whole pieces of its predecessor
    that make up at most ``overlap`` characters and leave room for the piece that comes next.
    """
    flat = BLANKS.sub(" ", text or "").strip(" ")
    removed, kept = ["\n"] if removed is None else removed, [".", "!", "?"] if kept is None else kept
    if len(flat) <= size:
        return [flat] if flat else []
    ends = cuts(flat, size, [*removed, *kept, " "])
    pieces = [flat[a:b] for a, b in zip(ends, ends[1:])]
    for sep in removed:
        pieces = [p.rstrip(" ").removesuffix(sep) if p.rstrip(" ").endswith(sep) else p for p in pieces]
    total = [0, *accumulate(map(len, pieces))]
    out, first, last = [], 0, 0
    while last < len(pieces):
        last = max(last + 1, bisect_right(total, total[first] + size) - 1)
        out.append("".join(pieces[first:last]).strip(" "))
        if last < len(pieces):
            room = max(0, min(overlap, size - len(pieces[last])))
            first = bisect_left(total, total[last] - room, first, last)
    return [c for c in out if c]


def chunk_column(text: Column, **options) -> Column:
    """The chunks of a text column (see ``chunk_text``); null and blank texts have none."""

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in text_slices(texts):
                yield pa.array([chunk_text(t.as_py(), **options) for t in some], pa.list_(pa.string()))

    return cut(text)


def chunked(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """One row per chunk: id (``parent#position``), origin_id, position and chunk."""
    rows = df.select(F.col(id_col).cast("string").alias("origin_id"), F.posexplode(chunk_column(F.col(text_col), **options)).alias("position", "chunk"))
    return rows.select(F.concat_ws("#", "origin_id", "position").alias("id"), "origin_id", "position", "chunk")
