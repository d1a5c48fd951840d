import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tesserine.llm import crosstok as C

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def encoders():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = C.byte_letters()
    a_bytes = lambda i: bytes(letters[x] for x in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: [(i, a_bytes(i)) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, b_bytes(i)) for i in b.encode(t)]


def ends(tokens):
    at, out = 0, []
    for i, raw in tokens:
        at += len(raw)
        out.append((i, at))
    return out


def brute(rows):
    """By the libraries alone, on whole texts, and groups from the sets of ends."""
    enc_a, enc_b = encoders()
    out, links = [], []
    for _, t in rows:
        a, b = (enc_a(t), enc_b(t)) if t else ([], [])
        if not t or any(b"".join(x for _, x in y) != (" " + t).encode() for y in (a, b)):
            a = b = []
        a, b = ends(a), ends(b)
        groups, ga, gb = [], [], []
        both = {e for _, e in a} & {e for _, e in b}
        for e in sorted({e for _, e in a + b}):
            ga += [i for i, x in a if x == e] if len(a) < 400 else []
            gb += [i for i, x in b if x == e] if len(a) < 400 else []
            if e in both and len(a) < 400:
                groups.append((ga, gb))
                ga, gb = [], []
        b_at = {e: i for i, e in b}
        links.append([(i, b_at[e]) for i, e in a if e in b_at])
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([len(a), len(b), len(both), len(links[-1]), hashlib.sha256(line.encode()).hexdigest() if groups else "", groups])
    n = Counter(x for y in links for x in y)
    most = Counter()
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    return [(i, x[0], x[1], x[2], x[3], sum(n[p] == most[p[1]] for p in y), sum(n[p] for p in y), x[4]) for (i, _), x, y in zip(rows, out, links)], [x[5] for x in out]


def texts(seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "internationalisation", "naïve", "Größe", "日本語", "12345", "é", "don't", "_x", "...", " ", "👩‍👩‍👧", "<|endoftext|>", "<s>", "<0x41>", "foo\tbar", "\n\n", "a\r\nb", "　", "ﬁ", "\x00", "Σίσυφος", "हिन्दी"]
    out = [None, "", " ", "   ", "\n", "x", "▁", "a ▁b", "  two  blanks ", "﻿"]
    out += ["".join(rng.choice(["", " ", " ", " ", "  "]) + rng.choice(words) for _ in range(rng.choice([1, 5, 40]))) for _ in range(120)]
    return out + out[10:20]


@pytest.mark.parametrize("table", ["broadcast", "joined"])
def test_equals_the_libraries(spark, monkeypatch, table):
    if table == "joined":
        monkeypatch.setattr(C, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(C, "PAIR_ROWS", 50)
    rows = [(i if i % 9 else None if i % 2 else 5, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, codes string, n int, row string").repartition(5)
    got = C.alignment(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows)[0])
    assert C.alignment(df.limit(0), A, B).count() == 0


def test_groups_themselves(spark):
    rows = [(i, t) for i, t in enumerate(texts(2)[:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(list(g.a_ids), list(g.b_ids)) for g in r.groups] for r in C.group_table(df, A, B).collect()}
    assert got == {i: g for (i, _), g in zip(rows, brute(rows)[1])}


def test_pointers_reach_the_end_of_long_components():
    """One boundary shared at the very end: every jump is needed."""
    a, b = np.r_[np.arange(2, 4001, 2)], np.r_[np.arange(1, 4000, 2), 4000]
    for last in C.last_tokens(a, b):
        assert set(last.tolist()) == {len(b) - 1}
    same = np.arange(1, 50)
    assert (C.last_tokens(same, same)[0] == np.arange(49)).all() and len(C.last_tokens(same[:0], same[:0])[0]) == 0


def test_long_texts_and_other_vocabularies(tmp_path):
    enc_a, enc_b = encoders()
    aligner = C.Aligner(A, B)
    long = ["ab" * 20_000, " " * 20_000 + "x", "\n" * 9_999, "word and " * 9_000]
    for t, (a, b) in zip(long, aligner.tokens(long)):
        assert a == [i for i, _ in enc_a(t)] and b == [i for i, _ in enc_b(t)]
    spec = json.load(open(A, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True  # not what ranks do: by the library
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert C.ByteLevel(str(path))(["a b"]) == [Tokenizer.from_file(str(path)).encode("a b").ids]
    aligner.b.by_word = False
    assert aligner.tokens(texts()) == C.Aligner(A, B).tokens(texts())
