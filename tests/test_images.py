"""Images: formats, resizing by area, gradients, and Spark's decoder."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.functions import images as G


def picture(h=12, w=9, c=3, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)


def filtered_png(pixels, kinds, colour, palette=None):
    """A PNG whose rows use the given filters."""
    h, w, c = pixels.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    x, raw = pixels.reshape(h, w * c).astype(int), b""
    for y in range(h):
        kind, line = kinds[y % len(kinds)], []
        for i in range(w * c):
            a, b, d = (x[y, i - c] if i >= c else 0), (x[y - 1, i] if y else 0), (x[y - 1, i - c] if y and i >= c else 0)
            p = a + b - d
            best = min((abs(p - v), n) for n, v in enumerate((a, b, d)))[1]
            line.append((x[y, i] - [0, a, b, (a + b) // 2, (a, b, d)[best]][kind]) % 256)
        raw += bytes([kind, *line])
    extra = part(b"PLTE", palette.tobytes()) if palette is not None else b""
    return G.PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + extra + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.mark.parametrize("colour,channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_of_all_filters(colour, channels):
    p = picture(c=channels)
    got = G.decode_image(filtered_png(p, [0, 1, 2, 3, 4], colour))
    assert np.array_equal(got, p[:, :, : 1 if channels < 3 else 3])


def test_formats_and_what_is_none():
    p = picture()
    assert np.array_equal(G.decode_image(G.encode_png(p)), p)
    assert np.array_equal(G.decode_image(b"P6\n# a note\n9 12\n255\n" + p.tobytes()), p)
    colours, marks = picture(1, 5)[0], picture(4, 4, 1) % 5
    assert np.array_equal(G.decode_image(filtered_png(marks, [0], 3, colours)), colours[marks[:, :, 0]])
    whole = G.encode_png(p)
    for bad in (None, b"", b"text", whole[:40], whole[:-30], b"P5 9 9 255\n12", b"P5 0 9 255\n", G.PNG, whole.replace(b"IDAT", b"IDAX")):
        assert G.decode_image(bad) is None and G.resized_blob(bad) is None


def test_area_resize_equals_plain_means():
    p = picture(7, 10)
    for h, w in ((7, 10), (3, 4), (1, 1), (5, 10), (7, 3)):
        got = G.area_resize(p, h, w)
        for y in range(h):
            for x in range(w):
                share = lambda lo, hi, n: [max(0.0, min(hi, i + 1) - max(lo, i)) for i in range(n)]
                rows, columns = share(y * 7 / h, (y + 1) * 7 / h, 7), share(x * 10 / w, (x + 1) * 10 / w, 10)
                mean = sum(r * c * p[i, j].astype(float) for i, r in enumerate(rows) for j, c in enumerate(columns)) / (7 / h * 10 / w)
                assert np.abs(got[y, x] - mean).max() <= 0.5 + 1e-6
    assert G.within(448, 100) == (224, 50) and G.within(10, 20) == (10, 20) and G.within(5000, 1) == (224, 1)


def test_columns_and_files(spark, tmp_path):
    p = picture(40, 30)
    blobs = [(1, G.encode_png(p)), (2, None), (3, b"none"), (4, G.encode_png(p)), (5, b"P5 2 2 255\n\x00\x00\xff\xff")]
    df = spark.createDataFrame(blobs, "id long, blob binary").repartition(2)
    got = {r.id: r.b for r in df.select("id", G.resize_blobs(F.col("blob"), 20).alias("b")).collect()}
    assert got[1] == got[4] == G.encode_png(G.area_resize(p, 20, 15)) and got[2] is None and got[3] is None
    (tmp_path / "a.png").write_bytes(blobs[0][1])
    (tmp_path / "no.png").write_bytes(b"no image")
    files = G.load_images(spark, str(tmp_path), 20).collect()
    assert len(files) == 1 and files[0].id.endswith("a.png") and bytes(files[0].blob) == got[1]


def test_gradients_tell_directions(spark):
    e = G.GradientEmbedder()
    flat = lambda x: np.repeat(x[:, :, None], 3, axis=2).astype(np.uint8)
    y, x = np.mgrid[0:64, 0:64]
    across, down, again = (e.query(G.encode_png(flat(v))) for v in (x * 3, y * 3, x * 2 + 9))
    assert across @ again > 0.99 and across @ down < 0.05 and np.isclose(across @ across, 1)
    assert not e.query(G.encode_png(flat(x * 0 + 7))).any() and not e.query(b"?").any() and len(across) == e.length
    df = spark.createDataFrame([(1, G.encode_png(flat(x * 3))), (2, None), (3, b"?")], "id long, blob binary")
    got = {r.id: np.array(r.v) for r in df.select("id", e.column(F.col("blob")).alias("v")).collect()}
    assert np.allclose(got[1], across) and not got[2].any() and not got[3].any()
