"""Media columns: signature sniffing, structural validation, type correction and carving.

An Aho-Corasick automaton locates magic bytes anywhere in a binary value. At each hit a
validator of that format walks the structure (chunks, segments, pages, boxes) and returns the
length of a well-formed item, or nothing. The item at offset 0 corrects the declared type; items
further inside are carved.

Defined cases: null bytes count as empty, have no type and no items; a null id is kept; a value whose structure is
broken or cut short is not that format; repeated rows repeat; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .textops import map_texts, sized_slices, small_batches


def _png(b: bytes, at: int) -> int | None:
    """Chunks with right CRCs from IHDR to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if (kind == b"IHDR") != first or p + 12 + n > len(b):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    """Screen descriptor, then blocks up to the trailer."""
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x2C:
            if p + 10 > len(b):
                return None
            p += 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 128 else 0)
        elif kind == 0x21:
            p += 2
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    """Marker segments up to the scan, then the end marker."""
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        if b[p + 1] == 0xFF:  # a marker may have fill bytes in front
            p += 1
            continue
        kind, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if kind < 0xC0 or n < 2 or p + 2 + n > len(b):
            return None
        p += 2 + n
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", p)
            return end + 2 - at if end >= 0 else None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    size, reserved, offset, head = struct.unpack_from("<IIII", b, at + 2)
    ok = not reserved and head in (12, 40, 52, 56, 108, 124) and 14 + head <= offset <= size <= len(b) - at
    return size if ok else None


def riff_chunks(b: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, start of data, length) of the chunks of a RIFF form; ends early where one doesn't fit."""
    p = at + 12
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, p)
        if p + 8 + n > end:
            return
        yield kind, p + 8, n
        p += 8 + n + (n & 1)


def _riff(b: bytes, at: int, need: set[bytes]) -> int | None:
    if at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    kinds, last = set(), at + 12
    for kind, start, n in riff_chunks(b, at, end):
        kinds.add(kind)
        last = start + n + (n & 1)
    return end - at if kinds & need and end - 1 <= last <= end + 1 else None


def _crc_table(polynomial: int, bits: int) -> list[int]:
    """Remainders of all bytes, most significant bit first."""
    out, top = [], 1 << bits - 1
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = x << 1 ^ (polynomial if x & top else 0)
        out.append(x & (1 << bits) - 1)
    return out


#: The polynomials of Ogg pages and of FLAC frames and headers.
OGG_CRC, FLAC_CRC16, FLAC_CRC8 = _crc_table(0x04C11DB7, 32), _crc_table(0x8005, 16), _crc_table(0x07, 8)


def _ogg(b: bytes, at: int) -> int | None:
    """Pages with right checksums from the first of a stream to its last."""
    p = at
    if b[p + 5 : p + 6] and not b[p + 5] & 2:
        return None
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS":
        n = b[p + 26]
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + size > len(b):
            return None
        crc = 0
        for x in b[p : p + 22] + b"\0\0\0\0" + b[p + 26 : p + size]:
            crc = (crc << 8) & 0xFFFFFFFF ^ OGG_CRC[(crc >> 24) ^ x]
        if crc != struct.unpack_from("<I", b, p + 22)[0]:
            return None
        p += size
        if b[p - size + 5] & 4:
            return p - at
    return None


def _flac_header(b: bytes, p: int) -> tuple[int, int] | None:
    """(end of the header, samples) of a frame whose header has the right checksum."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or not b[p + 2] >> 4 or b[p + 2] & 15 == 15:
        return None
    size, rate, q = b[p + 2] >> 4, b[p + 2] & 15, p + 4
    lead = next((i for i in range(8) if not b[q] << i & 128), 8)  # the number of the frame, like a UTF-8 character
    q += max(1, lead)
    extra = {6: 1, 7: 2}.get(size, 0)
    samples = 192 if size == 1 else 576 << size - 2 if size < 6 else int.from_bytes(b[q : q + extra], "big") + 1 if size < 8 else 256 << size - 8
    q += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in b[p:q]:
        crc = FLAC_CRC8[crc ^ x]
    return (q + 1, samples) if q < len(b) and b[q] == crc else None


def _flac(b: bytes, at: int) -> int | None:
    """STREAMINFO first, then metadata blocks, then frames with right checksums: all samples that are announced, or as far as frames follow."""
    p, first, total = at + 4, True, 0
    while p + 4 <= len(b):
        head, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (head & 127 or n != 34) or p + 4 + n > len(b):
            return None
        if first:
            total = int.from_bytes(b[p + 17 : p + 22], "big") & (1 << 36) - 1
        p, first = p + 4 + n, False
        if head & 128:
            break
    else:
        return None
    have = 0
    while (frame := _flac_header(b, p)) and (not total or have < total):
        q, samples = frame
        crc, end = 0, None
        for i in range(p, len(b)):
            crc = (crc << 8) & 0xFFFF ^ FLAC_CRC16[(crc >> 8) ^ b[i]]
            if not crc and i > q and (i + 1 == len(b) or 0 < total <= have + samples or not total or _flac_header(b, i + 1)):  # a frame and its checksum leave nothing
                end = i + 1
                break
        if end is None:
            return None
        p, have = end, have + samples
    return p - at if have and have >= total else None


def _mp4(b: bytes, at: int) -> int | None:
    """Boxes with printable names, of 32-bit or 64-bit length or up to the end of the value; a movie box among them."""
    p, kinds = at - 4, set()
    start = p
    while 0 <= p and p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        least = 8
        if n == 1 and p + 16 <= len(b):
            n, least = struct.unpack_from(">Q", b, p + 8)[0], 16
        elif n == 0 and kinds:
            n = len(b) - p
        if n < least or p + n > len(b) or not kind.isalnum():
            break
        kinds.add(kind)
        p += n
    return p - start if kinds & {b"moov", b"moof"} else None


#: magic bytes -> (media type, offset of the item before the magic, validator)
FORMATS = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0, _png),
    b"GIF87a": ("image/gif", 0, _gif),
    b"GIF89a": ("image/gif", 0, _gif),
    b"\xff\xd8\xff": ("image/jpeg", 0, _jpeg),
    b"BM": ("image/bmp", 0, _bmp),
    b"WAVE": ("audio/wav", 8, lambda b, at: _riff(b, at - 8, {b"data"}) if b[at - 8 : at - 4] == b"RIFF" else None),
    b"WEBP": ("image/webp", 8, lambda b, at: _riff(b, at - 8, {b"VP8 ", b"VP8L", b"VP8X"}) if b[at - 8 : at - 4] == b"RIFF" else None),
    b"OggS": ("audio/ogg", 0, _ogg),
    b"fLaC": ("audio/flac", 0, _flac),
    b"ftyp": ("video/mp4", 4, _mp4),
}


def build_automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for magic in FORMATS:
        auto.add_word(magic.decode("latin-1"), magic)
    auto.make_automaton()
    return auto


def sniff(value: bytes, auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Well-formed items as (type, offset, length) by offset; what lies inside an item other than the first is that item's."""
    found, over, pages = [], 0, 0  # pages: how far a stream at offset 0 goes, whose pages are no items of their own
    for last, magic in auto.iter(value.decode("latin-1")):
        kind, back, check = FORMATS[magic]
        hit = last - len(magic) + 1
        at = hit - back
        if at < 0 or at < over or magic == b"OggS" and at < pages:
            continue
        if (n := check(value, hit)) is not None:
            found.append((kind, at, n))
            over = at + n if at else 0
            pages = n if magic == b"OggS" and not at else pages
    return sorted(found, key=lambda x: x[1])


ITEM = T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])


def _over_values(df: DataFrame, id_col: str, bytes_col: str, columns: list[str], fields: list[T.StructField], run) -> DataFrame:
    """``run(automaton, values, columns)`` over slices of the rows: output rows as (number of the row, values of ``fields``), beside the row's id and ``columns``."""
    kept = [df.schema[id_col], *[df.schema[c] for c in columns]]
    schema = T.StructType([*kept, *fields])
    arrow = to_arrow_schema(schema)
    n = len(kept)

    def each(batches):
        auto = build_automaton()
        for batch in batches:
            for part in sized_slices(batch, n):
                of, rows = run(auto, part.column(n).to_pylist(), [part.column(i).to_pylist() for i in range(1, n)])
                own = [part.column(i).take(pa.array(of, pa.int64())) for i in range(n)]
                made = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(fields), list(arrow)[n:])]
                yield pa.RecordBatch.from_arrays([*[o.cast(f.type) for o, f in zip(own, arrow)], *made], schema=arrow)

    return df.select(id_col, *columns, F.col(bytes_col).cast("binary").alias("__value")).mapInArrow(each, schema)


def sniff_media(df: DataFrame, id_col: str, bytes_col: str, declared_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns ``keep``, declared_type, media_type (corrected; the declared one where nothing is recognised), type_ok and items."""

    def run(auto, values, columns):
        rows = []
        for value, told in zip(values, columns[-1]):
            items = sniff(value or b"", auto)
            true = next((k for k, at, _ in items if at == 0), None)
            rows.append((told, true or told, true == told if true else None, [{"type": k, "offset": a, "length": n} for k, a, n in items]))
        return range(len(rows)), rows

    small_batches(df.sparkSession)
    fields = [T.StructField("declared_type", T.StringType()), T.StructField("media_type", T.StringType()), T.StructField("type_ok", T.BooleanType()), T.StructField("items", T.ArrayType(ITEM))]
    told = df.withColumn("__told", F.col(declared_col).cast("string"))
    return _over_values(told, id_col, bytes_col, [*keep, "__told"], fields, run).drop("__told")


def carve_media(df: DataFrame, id_col: str, bytes_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per media item embedded at an offset above 0: id, the columns ``keep``, type, offset, length, content."""

    def run(auto, values, columns):
        found = [(i, (k, a, n, v[a : a + n])) for i, v in enumerate(values) for k, a, n in sniff(v or b"", auto) if a]
        return [i for i, _ in found], [row for _, row in found]

    small_batches(df.sparkSession)
    return _over_values(df, id_col, bytes_col, [*keep], [*ITEM.fields, T.StructField("content", T.BinaryType())], run)


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """``payload`` as the 8-bit mono samples of a WAV file."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def wav_samples(media: bytes) -> bytes:
    """The sample bytes of a well-formed WAV file."""
    end = 8 + struct.unpack_from("<I", media, 4)[0]
    return b"".join(media[s : s + n] for kind, s, n in riff_chunks(media, 0, end) if kind == b"data")


def pad_text(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


#: Types that stored texts are declared under; the last is right.
DECLARED = ("image/png", "video/mp4", "application/octet-stream", "audio/wav")


def stored_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (of the text), media (its WAV) and a declared type that its bytes choose, right for about a quarter of the texts."""

    def one(text):
        n, payload = pad_text(text)
        return n, to_wav(payload), DECLARED[zlib.crc32(payload) % len(DECLARED)]

    columns = [("n_bytes", T.LongType()), ("media", T.BinaryType()), ("declared", T.StringType())]
    return map_texts(df, lambda: lambda texts: list(zip(*map(one, texts))), columns, id_col, text_col)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text stored as an 8-bit WAV (``stored_texts``), its type corrected, carved from a carrier and read back.

    The media go through ``sniff_media`` under their declared type, are put into other bytes, and come
    out again through ``carve_media``; the samples are read from what was carved. The feature string
    holds the declared and the corrected type, where the item was found, the number of samples, their mean
    and root mean square in 8-bit units, the number of sign changes around the middle, and the
    number of items that sniffing found inside the media.
    """
    sniffed = sniff_media(stored_texts(df, id_col, text_col), id_col, "media", "declared", keep=("n_bytes", "media"))
    front = F.repeat(F.lit("-"), (F.col("n_bytes") % 61 + 3).cast("int"))
    inside = F.size(F.filter("items", lambda i: i["offset"] > 0))
    carriers = sniffed.select(id_col, "n_bytes", "declared_type", "media_type", inside.alias("inside"), F.concat(F.encode(front, "utf-8"), F.col("media"), F.encode(F.lit("--"), "utf-8")).alias("carrier"))
    carved = carve_media(carriers, id_col, "carrier", keep=("n_bytes", "declared_type", "media_type", "inside"))
    fields = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]

    def run(_, values, columns):
        rows = []
        for media, _, told, kind, inner, type_, at in zip(values, *columns):
            back = wav_samples(media) if type_ == "audio/wav" else b""
            x = np.frombuffer(back, np.uint8).astype(np.int64)
            above = x >= 128
            feature = f"{kind};declared={told};carved={type_}@{at};n={len(x)};mean={x.sum() / max(1, len(x)):.6f};rms={np.sqrt((x * x).sum() / max(1, len(x))):.6f};turns={int((above[1:] != above[:-1]).sum())};inside={inner}"
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        return range(len(rows)), rows

    done = _over_values(carved, id_col, "content", ["n_bytes", "declared_type", "media_type", "inside", "type", "offset"], [T.StructField(n, t) for n, t in fields], run)
    return done.select(id_col, "n_bytes", *[n for n, _ in fields], "media_type")
