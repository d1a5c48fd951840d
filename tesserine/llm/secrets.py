"""Secret scanning: keyword automaton, anchored expressions near its hits, checksum validation.

One pass of an Aho-Corasick automaton over the text finds where a secret can be at all: the
keywords of assignments, the prefixes of access keys and of tokens with a checksum, and every
run of three lower-case hex digits (a run of 24 holds one). Regular expressions are tried only
at those places. Tokens that carry their own checksum or structure are reported only when it
holds.

Defined cases: a null text counts as empty and has no spans; a null id is kept; repeated rows
give repeated results; an empty table gives an empty result; spans of different kinds may overlap; offsets
are code points with an exclusive end.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .textops import map_texts, small_batches

#: Kinds in the order in which they are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv", "jwt")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]+")
HEX_BACK = re.compile(r"[0-9a-f]*\Z")
CHECKED = {
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "xprv": re.compile(rf"xprv[{BASE58}]{{107}}(?![A-Za-z0-9])"),
}
#: The first part from some place on, and the second and third part where both dots stand.
JWT_PARTS = re.compile(r"([A-Za-z0-9_-]*+)(?:\.([A-Za-z0-9_-]++)\.[A-Za-z0-9_-]*+)?")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
    "jwt": ("eyj",),
}
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def build_automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    digits = "0123456789abcdef"
    for key in (a + b + c for a in digits for b in digits for c in digits):
        auto.add_word(key, ("hex", 3))
    for kind, words in KEYWORDS.items():
        for word in words:
            auto.add_word(word, (kind, len(word)))
    auto.make_automaton()
    return auto


def _base62_crc(body: str, check: str) -> bool:
    """The last six characters are the CRC-32 of the others in base 62, padded with zeros."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0") == check


def _base58_check(word: str) -> bool:
    """The last four bytes are the start of the double SHA-256 of the others."""
    n = 0
    for c in word:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes(82, "big") if n < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _base64_bytes(part: str) -> bytes:
    return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))


def _json_object(text: str, lo: int, hi: int) -> dict | None:
    """The object that ``text[lo:hi]`` holds in base64url; read in growing pieces, so that what is no JSON ends early."""
    size = 512
    while True:
        whole = size >= hi - lo
        try:
            raw = _base64_bytes(text[lo : hi if whole else lo + size])
            if not raw.lstrip(b" \t\r\n").startswith(b"{"):
                return None
            found = json.loads(raw)
            if whole:
                return found if isinstance(found, dict) else None  # else only blanks may follow
        except json.JSONDecodeError as error:
            unclosed = error.msg.startswith("Unterminated") or error.pos >= len(error.doc) - 16
            if whole or not unclosed:
                return None
        except UnicodeDecodeError as error:
            if whole or error.start < len(raw) - 4:  # a cut may stand inside a character
                return None
        except RecursionError:
            return None
        except (ValueError, binascii.Error):
            if whole:
                return None
        size *= 4


def _jwt_header(text: str, lo: int, hi: int) -> bool:
    """``text[lo:hi]`` is base64url JSON that names an algorithm; its last bytes are looked at first."""
    over = (hi - lo) % 4
    if over == 1 or _base64_bytes(text[hi - (over or 4) : hi])[-1:] not in (b"}", b" ", b"\t", b"\r", b"\n"):
        return False
    head = _json_object(text, lo, hi)
    return head is not None and isinstance(head.get("alg"), str)


def _valid(kind: str, m: re.Match) -> bool:
    return _base58_check(m[0]) if kind == "xprv" else _base62_crc(m[1], m[2])


def find_secrets(text: str, auto: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans of one text as (start, end, kind), by start and then kind as listed."""
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lowered; ASCII alone keeps the offsets
        low = text.translate(ASCII_LOWER)
    spans: list[tuple[int, int, str]] = []
    over = dict.fromkeys(KINDS, 0)  # where the last match of each kind ended
    parts, head = None, 0  # of a token: the match of its parts, and where its first part ends
    for last, (kind, size) in auto.iter(low):
        at = last - size + 1
        if at < over[kind]:
            continue
        if kind == "hex":
            m = HEX_RUN.match(text, at)
            if not m:
                continue
            start = at  # everything of this run before the hit is shorter than three digits
            while start > over[kind] and text[start - 1] in "0123456789abcdef":
                start -= 1
            over[kind] = m.end()
            if m.end() - start >= 24:
                spans.append((start, m.end(), kind))
        elif kind == "assign":
            if m := ASSIGN.match(text, at):
                over[kind] = m.end()
                if len(m[1]) >= 6:
                    spans.append((at, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                over[kind] = m.end()
                if m.end() - at >= 20:
                    spans.append((at, m.end(), kind))
        elif kind == "jwt":
            if not text.startswith("eyJ", at):
                continue
            if at >= head:  # the other parts are the same wherever in this run a token begins
                parts = JWT_PARTS.match(text, at)
                head = parts.end(1)
                if not parts[2] or _json_object(text, *parts.span(2)) is None:
                    over[kind] = head
                    continue
            if at + 4 <= head and _jwt_header(text, at, head):
                over[kind] = parts.end()
                spans.append((at, parts.end(), kind))
        elif (m := CHECKED[kind].match(text, at)) and _valid(kind, m):
            over[kind] = m.end()
            spans.append((at, m.end(), kind))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id and ``spans``, an array of (kind, start, end)."""

    def make():
        auto = build_automaton()
        return lambda texts: [[[{"kind": k, "start": s, "end": e} for s, e, k in find_secrets(t, auto)] if t else [] for t in texts]]

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return map_texts(df, make, [("spans", T.ArrayType(span))], id_col, text_col)


def redact_secrets(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every secret of ``text_col`` replaced by ``mask``; overlapping spans give one mask.

    Null stays null; the other columns are kept as they are.
    """
    small_batches(df.sparkSession)

    @pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = build_automaton()

        def one(text):
            if not text:
                return text
            out, at = [], 0
            for start, end, _ in find_secrets(text, auto):
                if start >= at:
                    out += [text[at:start], mask]
                at = max(at, end)
            return "".join([*out, text[at:]]) if out else text

        for texts in batches:
            yield texts.map(one, na_action="ignore")

    return df.withColumn(text_col, redact(F.col(text_col)))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def secret_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    found = secret_spans(df, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
