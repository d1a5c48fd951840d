"""Images in blobs: reading, resizing by area, and vectors without a model.

Files are decoded by Spark's image source (``load_images``). Blobs in columns are decoded here, in Arrow
batches: PNG (8 bits a channel, not interlaced) and binary PNM; others give null. A resized pixel is the
mean of what it covers, parts of pixels counted by their share, rounded half up.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.vectors import l2

#: The greatest height and width that a resized image has.
MOST = 224
PNM = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+255\s")
PNG = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: bytes, height: int, width: int, channels: int) -> np.ndarray | None:
    """Rows of a PNG without their filters."""
    size = width * channels
    if len(raw) < height * (size + 1):
        return None
    lines = np.frombuffer(raw, np.uint8, height * (size + 1)).reshape(height, size + 1)
    out, above = np.zeros((height, size), np.uint8), np.zeros(size, np.uint8)
    for y, line in enumerate(lines):
        kind, row = line[0], line[1:].copy()
        if kind == 1:
            row = np.cumsum(row.reshape(width, channels), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            flat, up = row.tolist(), above.tolist()
            for x in range(size):
                a, b = flat[x - channels] if x >= channels else 0, up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[x - channels] if x >= channels else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                flat[x] = (flat[x] + guess) & 255
            row = np.array(flat, np.uint8)
        elif kind:
            return None
        out[y] = above = row
    return out.reshape(height, width, channels)


def _png(blob: bytes) -> np.ndarray | None:
    at, data, head, colours = 8, [], None, None
    while at + 12 <= len(blob):
        size, kind = struct.unpack_from(">I4s", blob, at)
        body = blob[at + 8 : at + 8 + size]
        if len(body) < size:
            return None
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            colours = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        return None
    width, height, _, colour = head[:4]
    try:
        pixels = _unfiltered(zlib.decompress(b"".join(data)), height, width, CHANNELS[colour])
    except zlib.error:
        return None
    if pixels is None or not pixels.size:
        return None
    if colour == 3:
        return None if colours is None or pixels.max() >= len(colours) else colours[pixels[:, :, 0]]
    return pixels[:, :, : 1 if colour == 4 else 3]  # without transparency


def decode_image(blob: bytes | None) -> np.ndarray | None:
    """Bytes (height, width, 1 or 3 channels), or nothing where it is no image of a known format."""
    if not blob:
        return None
    if blob.startswith(PNG):
        return _png(blob)
    if m := PNM.match(blob):
        channels, width, height = (1 if m[1] == b"5" else 3), int(m[2]), int(m[3])
        if width * height and len(blob) - m.end() >= width * height * channels:
            return np.frombuffer(blob, np.uint8, width * height * channels, m.end()).reshape(height, width, channels)
    return None


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, channels = pixels.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return PNG + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


@lru_cache(64)
def _shares(old: int, new: int) -> np.ndarray:
    """What each of ``new`` places covers of ``old`` ones; rows sum to 1."""
    edge = np.arange(new + 1) * (old / new)
    low, high = np.maximum(edge[:-1, None], np.arange(old)), np.minimum(edge[1:, None], np.arange(1, old + 1))
    return np.maximum(high - low, 0) / (old / new)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image with another height and width, every pixel the mean of what it covers."""
    rows, columns = _shares(pixels.shape[0], height), _shares(pixels.shape[1], width)
    mean = np.einsum("yh,hwc,xw->yxc", rows, pixels.astype(float), columns, optimize=True)
    return np.floor(mean + 0.5 + 1e-9).astype(np.uint8)


def within(height: int, width: int, most: int = MOST) -> tuple[int, int]:
    """Height and width of an image that keeps its shape and is at most ``most`` on either side; small ones stay as they are."""
    by = min(1.0, most / max(height, width))
    return max(1, int(height * by + 0.5)), max(1, int(width * by + 0.5))


def resized_blob(blob: bytes | None, most: int = MOST) -> bytes | None:
    pixels = decode_image(blob)
    return None if pixels is None else encode_png(area_resize(pixels, *within(*pixels.shape[:2], most)))


def resize_blobs(blob: Column, most: int = MOST) -> Column:
    """Blobs as PNG of at most ``most`` pixels on either side; null for what is no image. Equal blobs of a batch are worked on once."""

    @F.pandas_udf("binary")
    def resize(blobs: pd.Series) -> pd.Series:
        once = {b: resized_blob(b, most) for b in set(blobs.dropna())}
        return blobs.map(once.get)

    return resize(blob)


def load_images(spark: SparkSession, path: str, most: int = MOST) -> DataFrame:
    """Image files of a folder as (id, blob), decoded by Spark, resized and stored as PNG; files that are no images are left out."""

    @F.pandas_udf("binary")
    def png(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for h, w, c, raw in zip(height, width, channels, data):
            pixels = np.frombuffer(raw, np.uint8).reshape(h, w, c)[:, :, :3][:, :, ::-1]  # Spark's order is blue, green, red
            out.append(encode_png(area_resize(pixels, *within(h, w, most))))
        return pd.Series(out)

    rows = spark.read.format("image").option("dropInvalid", "true").load(path)
    return rows.select(F.col("image.origin").alias("id"), png("image.height", "image.width", "image.nChannels", "image.data").alias("blob"))


class GradientEmbedder:
    """Histograms of gradient directions: the image at 32 by 32 pixels in grey, in 4 by 4 fields of 8 directions each, weighted by strength, L2-normalised.

    Null and what is no image give zeros, as does an image of one colour.
    """

    SIDE, FIELDS, DIRECTIONS = 32, 4, 8
    length = FIELDS * FIELDS * DIRECTIONS

    def query(self, blob: bytes | None) -> np.ndarray:
        pixels = decode_image(blob)
        if pixels is None:
            return np.zeros(self.length)
        grey = area_resize(pixels, self.SIDE, self.SIDE).astype(float).mean(axis=2)
        dy, dx = np.gradient(grey)
        way = np.floor((np.arctan2(dy, dx) % np.pi) / np.pi * self.DIRECTIONS + 1e-9).astype(int) % self.DIRECTIONS
        field = np.arange(self.SIDE) * self.FIELDS // self.SIDE
        at = (field[:, None] * self.FIELDS + field[None, :]) * self.DIRECTIONS + way
        return l2(np.bincount(at.ravel(), weights=np.hypot(dx, dy).ravel(), minlength=self.length))

    def column(self, blob: Column) -> Column:
        one = self.query

        @F.pandas_udf("array<double>")
        def embed(blobs: pd.Series) -> pd.Series:
            once = {b: one(b) for b in set(blobs.dropna())}
            zeros = np.zeros(GradientEmbedder.length)
            return blobs.map(lambda b: once.get(b, zeros))

        return embed(blob)


class ByteEmbedder:
    """How often bytes of each of sixteen equal ranges of values occur in a blob, L2-normalised.

    For blobs that are no images: equal files are near each other and so are files of
    one format. Null and empty blobs give zeros.
    """

    length = 16

    def query(self, blob: bytes | None) -> np.ndarray:
        return l2(np.bincount(np.frombuffer(blob or b"", np.uint8) >> 4, minlength=16).astype(float))

    def column(self, blob: Column) -> Column:
        one = self.query

        @F.pandas_udf("array<double>")
        def embed(blobs: pd.Series) -> pd.Series:
            return blobs.map(one)

        return embed(blob)
