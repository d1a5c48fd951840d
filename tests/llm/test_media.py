import hashlib
import io
import struct
import wave
import zlib

from tesserine.llm import media as M


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\xff\xff\xff\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def test_round_trip(spark):
    texts = [None, "", "abc", "é" * 32, "x" * 64, "y" * 65, "BM GIF89a RIFF WAVE ftyp", "long " * 200000, "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' as feature")
    rows = {r.doc_id: r for r in M.text_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, (len(raw) + 63) // 64 * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_type == "audio/wav"
        with wave.open(io.BytesIO(M.to_wav(payload))) as w:
            assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, payload)
    assert rows[2][1:] == rows[8][1:]
    assert M.text_media(df.limit(0)).count() == 0


def test_types_corrected_and_carved(spark):
    wav = M.to_wav(b"\x80" * 64)
    values = [(1, png(), "image/gif"), (2, GIF, "image/gif"), (3, wav[:-1], "audio/wav"), (4, b"junk" + png() + b"mid" + GIF + b"BM", "text/plain"), (5, None, None), (6, b"", "x/y"), (7, png()[:-3], "image/png"), (8, wav + b"tail", "audio/ogg")]
    df = spark.createDataFrame(values, "k long, body binary, told string")
    rows = {r.k: r for r in M.sniff_media(df, "k", "body", "told").collect()}
    assert (rows[1].media_type, rows[1].type_ok) == ("image/png", False)
    assert (rows[2].media_type, rows[2].type_ok) == ("image/gif", True)
    assert rows[3]["items"] == [] and rows[7]["items"] == [] and rows[5]["items"] == [] and rows[6].media_type == "x/y"
    assert rows[8].media_type == "audio/wav"
    carved = sorted((r.k, r.type, r.offset, bytes(r.content)) for r in M.carve_media(df, "k", "body").collect())
    assert carved == [(4, "image/gif", 7 + len(png()), GIF), (4, "image/png", 4, png())]


def crc(data, polynomial, bits):
    """Bit by bit."""
    out = 0
    for x in data:
        out ^= x << bits - 8
        for _ in range(8):
            out = (out << 1 ^ (polynomial if out >> bits - 1 else 0)) & (1 << bits) - 1
    return out


def flac(frames, total):
    def frame(i, size):
        head = bytes([0xFF, 0xF8, 0x60 | 9, 0x08, i, size - 1])
        body = head + bytes([crc(head, 0x07, 8)]) + bytes((7 * i + k) % 251 for k in range(40))
        return body + crc(body, 0x8005, 16).to_bytes(2, "big")

    info = bytes(10) + (total | 44100 << 44).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x80\0\0\x22" + info + b"".join(frame(i, 100) for i in range(frames))


def ogg(pages):
    def page(i, body):
        p = b"OggS\0" + bytes([4 * (i == pages - 1) | 2 * (i == 0)]) + bytes(8) + struct.pack("<III", 7, i, 0) + bytes([1, len(body)]) + body
        return p[:22] + struct.pack("<I", crc(p, 0x04C11DB7, 32)) + p[26:]

    return b"".join(page(i, bytes([i]) * 30) for i in range(pages))


def box(kind, body, wide=False, to_end=False):
    return (struct.pack(">I4sQ", 1, kind, 16 + len(body)) if wide else struct.pack(">I4s", 0 if to_end else 8 + len(body), kind)) + body


def test_lengths_of_streams_and_boxes():
    auto = M.build_automaton()
    for n in (1, 3):
        whole = flac(n, 100 * n)
        assert M.sniff(b"xx" + whole + b"rest" + GIF, auto) == [("audio/flac", 2, len(whole)), ("image/gif", 6 + len(whole), len(GIF))]
        assert M.sniff(whole[:-1] + b"?", auto) == []
    assert M.sniff(flac(2, 0) + GIF, auto)[0] == ("audio/flac", 0, len(flac(2, 0)))
    assert M.sniff(ogg(3) + b"!", auto) == [("audio/ogg", 0, len(ogg(3)))] and M.sniff(ogg(3).replace(b"\1\1", b"\1\2", 1), auto) == []
    start = box(b"ftyp", b"isom0000")
    for tail in (box(b"moov", bytes(20)) + box(b"mdat", bytes(50), wide=True), box(b"mdat", bytes(9), wide=True) + box(b"moov", b"", to_end=True)):
        assert M.sniff(start + tail, auto) == [("video/mp4", 0, len(start + tail))]


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert sorted([(r.doc_id, r.n_bytes) for r in M.text_media(df).collect()], key=str) == [(1, 0), (None, 1), (None, 1)]


def test_texts_go_through_both_operators(spark):
    """The types that were declared, and texts that hold magic bytes or a whole file."""
    texts = ["abc", "def", "ghi", "jkl", "mno", "p" * 64, "GIF89a BM ID3 OggS fLaC", M.to_wav(b"a" * 8).decode("latin-1"), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    stored = {r.doc_id: r for r in M.stored_texts(df).collect()}
    rows = {r.doc_id: r for r in M.text_media(df).collect()}
    assert len(rows) == len(texts) and len({r.declared for r in stored.values()}) > 2
    for i, r in rows.items():
        media = bytes(stored[i].media)
        assert r.media_sha256 == hashlib.sha256(media).hexdigest() and r.media_bytes == len(media)
        assert r.feature.startswith(f"audio/wav;declared={stored[i].declared};carved=audio/wav@{r.n_bytes % 61 + 3};n={r.payload_bytes};")


def test_jpeg_with_fill_bytes():
    head = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9)
    tail = b"\xff\xda" + struct.pack(">H", 8) + bytes(6) + b"\x12\x34\xff\xd9"
    auto = M.build_automaton()
    for fill in (b"", b"\xff", b"\xff" * 3):
        whole = head + fill + tail
        assert M.sniff(whole + b"rest", auto) == [("image/jpeg", 0, len(whole))]
