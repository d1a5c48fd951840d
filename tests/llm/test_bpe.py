import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tesserine.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():

    rng = random.Random(3)
    word = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    return [
        None, "", " ", "\n\n  a\t\tb  ", "it's we'll I'M", "café naïve 你好世界 \U0001f600\U0001f600", "a" * 5001, "ab" * 3000, "=" * 700 + " " * 900,
        word(3000, "abcdefghijklmnopqrstuvwxyz"), word(2500, "etaoin"), word(400, "éèêçouv"), "\x1c\x1d\x85 x", "<|endoftext|>", "0123456789" * 40,
        " ".join(word(rng.randint(1, 14), "etaoinshrüößm") for _ in range(4000)), "it's we'll I'M",
    ]


def test_same_ids_as_the_library_and_round_trip(spark, library):
    rows = [(i, t, -1) for i, t in enumerate(texts())] + [(None, "no id, twice", 0), (None, "no id, twice", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(2)
    out = {r.doc_id: r for r in bpe.token_digests(df, RANKS, P.PATTERN).collect()}
    assert out[None].decoded_sha256 == hashlib.sha256(b"no id, twice").hexdigest()
    for i, t, _ in rows[:-2]:
        want = library.encode_ordinary(t or "")
        assert out[i].n_tokens == len(want), (i, (t or "")[:40])
        assert out[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want)).hexdigest(), i
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.token_digests(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_ids_and_content_columns(spark, library):
    df = spark.createDataFrame([(1, "héllo world"), (2, None)], "doc_id long, text string")
    ids = bpe.encode_texts(df, RANKS, P.PATTERN)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got == {1: library.encode_ordinary("héllo world"), 2: []}
    assert {r.doc_id: bytes(r.content) for r in bpe.decode_ids(ids, RANKS, P.PATTERN).collect()} == {1: "héllo world".encode(), 2: b""}


def test_kept_pieces_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    tok = bpe.Tokenizer(RANKS, P.PATTERN)
    for text in ("unwonted splendour of things", "thrumming anthills everywhere in rows", "unwonted"):
        assert tok.encode([text])[0] == b"".join(x.to_bytes(4, "little") for x in library.encode_ordinary(text))


def plain(ids, merges):
    """The leftmost pair of minimum rank, one at a time."""
    ids = list(ids)
    while True:
        best = min(((merges.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return ids
        ids[best[1] : best[1] + 2] = [best[0]]


@pytest.mark.parametrize("seed", range(6))
def test_long_rounds_equal_the_plain_order_on_random_vocabularies(tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    ranks = {bytes([i]): i for i in range(256)}
    grown = [b"a", b"b", b"c"]
    while len(ranks) < 256 + 60:
        new = rng.choice(grown) + rng.choice(grown)
        if len(new) <= 12 and new not in ranks:
            ranks[new] = -1
            grown.append(new)
    late = list(range(256, len(ranks)))
    rng.shuffle(late)  # parts may rank behind the tokens that they make
    ranks |= dict(zip([t for t, r in ranks.items() if r < 0], late))
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    monkeypatch.setattr(bpe, "ROUNDS", 3)
    tok = bpe.Tokenizer(str(tmp_path / "ranks"), P.PATTERN)
    merges = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    words = [rng.choices(b"abc", k=rng.randint(2, 60)) for _ in range(150)] + [b"a" * 41, b"ab" * 33, b"abc" * 30]
    seqs = lambda: [np.array(list(w), np.int32) for w in words]
    want = [plain(w, merges) for w in words]
    assert [x.tolist() for x in tok.merge(seqs(), False)] == want
    assert [x.tolist() for x in tok.merge(seqs(), True)] == want
    for long in (2, 5, 16):
        monkeypatch.setattr(bpe, "LONG", long)
        tok.fitting.clear()
        assert [x.tolist() for x in tok.joined([bytes(w) for w in words])] == want


def test_very_long_piece_and_text(library, monkeypatch):
    monkeypatch.setattr(bpe, "DECODED", 1000)
    monkeypatch.setattr(bpe, "BLOCK", 1000)
    tok = bpe.Tokenizer(RANKS, P.PATTERN)
    rng = random.Random(1)
    one = "".join(rng.choice("etaoinsrhl") for _ in range(3_000))  # one piece above a block
    many = "some words over and over " * 2_000
    got = tok.encode([one, many, None])
    assert got[0] == np.array(library.encode_ordinary(one), "<u4").tobytes() and got[1] == np.array(library.encode_ordinary(many), "<u4").tobytes() and got[2] == b""
    assert tok.decode(got) == [one.encode(), many.encode(), b""]


def test_long_pieces_without_safe_ranks_end_soon(library):
    import time

    tok, rng, start = bpe.Tokenizer(RANKS, P.PATTERN), random.Random(2), time.process_time()
    for piece in ("ab" * 500_000, "abc" * 33_333, "a" * 99_999, "=-" * 50_001, "".join(rng.choice("0123456789") for _ in range(50_000)), "internationalization" * 3_000, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(20_000))):
        assert tok.encode([piece])[0] == np.array(library.encode_ordinary(piece), "<u4").tobytes()
    assert time.process_time() - start < 30


def test_ascii_texts_are_cut_alike_by_the_faster_package():
    import regex

    rng, slow, fast = random.Random(7), regex.compile(P.PATTERN), bpe.ascii_pattern(P.PATTERN)
    for _ in range(3000):
        text = "".join(rng.choice([chr(rng.randrange(128)), "'s", "'LL", "'re", " ", "  \n", "\t", "\x1c", "\x0b", "ab", "_", "19"]) for _ in range(rng.randint(1, 40)))
        assert fast.findall(text) == slow.findall(text)
    assert all(bpe.ascii_pattern(p) is None for p in (r"(?i:'s)| ?\p{L}+", r"\p{N}{1,3}", r"[\p{L}\p{M}]+", r"[^\r\n\p{L}]?\p{Lu}", r"\w+"))


def test_decoding_keeps_order_and_ends_of_many_short_texts(monkeypatch):
    """Blocks that end inside texts and inside characters, and texts without ids among them."""
    monkeypatch.setattr(bpe, "DECODED", 7)
    tok, rng = bpe.Tokenizer(RANKS, P.PATTERN), random.Random(8)
    some = ["".join(rng.choice("aé你\U0001f600 \n") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    assert tok.decode(tok.encode(some)) == [t.encode() for t in some] and tok.decode([]) == [] and tok.decode([b"", b""]) == [b"", b""]
    calls = []
    kept = tok._table
    monkeypatch.setattr(tok, "_table", lambda sql, *a: calls.append(sql) or kept(sql, *a))
    tok.decode([b"\x05\0\0\0" * 9])
    assert calls and all("string_agg" not in c for c in calls)  # no sort per text
