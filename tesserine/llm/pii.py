"""Personal data: high-recall span generators, boosted trees, calibrated thresholds.

Generators propose overlapping spans: the four base kinds (email, ip, card, phone) with their
format checks, and looser forms (spelled-out mail addresses, phone numbers without a plus, social
security numbers, IBANs). Base spans always stay. Every other candidate is scored by
gradient-boosted trees on its format and the text around it, a logistic fit calibrates their
margin, and a kind's candidates are kept above the kind's threshold.

No labels are given; the trees learn from candidates that something else decides. Social security
numbers and IBANs have checks of their own, which are feature and label at once. For the other two kinds
base spans are rewritten where they stand: an email spelled out, a phone number without its plus
or its country code, or with other signs between its groups. What the generator then finds there is personal data; what it finds in the
text as it was is not where the digits are an address, a card or a date, or where nothing but a
plain "at" and a full stop make up the address. A quarter of these candidates is
held out for the calibration and for the thresholds, the least with which ``PRECISION`` of a
kind's held-out candidates above it are right; a kind without a positive candidate is not reported.

Only the fit uses a sample: about ``2 * FIT_ROWS`` documents chosen by the hash of their id, and of
their candidates at most ``FIT_SPANS`` per kind and outcome, those with the smallest hash.

Defined cases: a null text counts as empty and has no spans; a null id is kept; repeated rows
repeat; spans may overlap across kinds; offsets are code points with an exclusive end; without
candidates of both outcomes only base spans are reported; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .textops import hash_share, map_texts, sized_slices, small_batches

BASE = ("email", "ip", "card", "phone")
EXTRA = ("mail_words", "phone_loose", "ssn", "iban")
KINDS = (*BASE, *EXTRA)
FIT_ROWS, FIT_SPANS = 20_000, 2_500
#: Share of right ones that a kind's threshold must reach among held-out candidates.
PRECISION = 0.97

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    "mail_words": re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[A-Za-z]{2,24}){1,4}\b"),
    "phone_loose": re.compile(r"(?<![\w+.])\(?[0-9]{2,4}\)?(?:[ .-]\(?[0-9]{2,4}\)?){2,4}(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
}
CUES = ("phone", "tel", "call", "fax", "mobile", "ssn", "social", "security", "iban", "account", "bank", "card", "mail", "email", "contact", "ip", "from", "version", "isbn", "order", "id", "no", "date")
#: Words before a number that say it is another kind of number, and ends of domains that are common.
OTHER_NUMBERS = frozenset("part order invoice serial item lot ref reference model ticket batch sku isbn version no score scores coordinates page pages total totals years chapter case file receipt tracking".split())
ENDS = frozenset("com org net edu gov info io co de fr es it nl eu uk us ch at be pl se".split())
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches per kind that pass their checks, by kind and then start."""
    out, over, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end(), "email"))
            over = m.end()
        at = text.find("@", at + 1)
    if DIGITS.search(text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 if len(p) < 9 else not p.lstrip("0")[3:] and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return out


def iban_ok(word: str) -> bool:
    w = word.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in w[4:] + w[:4])) % 97 == 1


DATE = re.compile(r"(19|20)\d\d[ .-]\d\d[ .-]\d\d|\d\d[ .-]\d\d[ .-](19|20)\d\d")
SPELLED = re.compile(r"[(\[](?:at|dot)[)\]]| dot ")


def _decided(kind: str, word: str) -> bool | None:
    """What an extra candidate's own checks say; None where it has none."""
    if kind == "iban":
        return iban_ok(word)
    if kind == "ssn":
        return word[:3] not in ("000", "666") and word[0] != "9" and word[4:6] != "00" and word[7:] != "0000"
    if kind == "phone_loose":
        return False if not 7 <= len(DIGITS.findall(word)) <= 15 or DATE.fullmatch(word) or IP.fullmatch(word) or LOOSE["ssn"].fullmatch(word) else None
    return None if SPELLED.search(word) else False


def extras(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, bool | None]]:
    """Proposed spans beyond the base kinds as (start, end, kind, decided).

    Digits inside an ip, a card or what looks like an IBAN are no phone number, and those of a base phone are found already.
    """
    out = []
    if DIGITS.search(text):
        taken = [(s, e, k) for s, e, k in base if k != "email"] + [(*m.span(), "iban") for m in LOOSE["iban"].finditer(text)]
        for m in LOOSE["phone_loose"].finditer(text):
            over = {k for s, e, k in taken if s < m.end() and m.start() < e}
            if "phone" not in over:
                out.append((m.start(), m.end(), "phone_loose", False if over else _decided("phone_loose", m[0])))
        for kind in ("ssn", "iban"):
            out += [(m.start(), m.end(), kind, _decided(kind, m[0])) for m in LOOSE[kind].finditer(text)]
    if " at " in text or "at)" in text or "at]" in text:
        out += [(m.start(), m.end(), "mail_words", _decided("mail_words", m[0])) for m in LOOSE["mail_words"].finditer(text)]
    return out


def rewritten(text: str, base: list[tuple[int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Base emails and phones in looser forms: (text around with the new form, start, end, kind) of what the generators find there."""
    out = []
    for start, end, kind in base:
        word, style = text[start:end], crc32(text[start:end].encode("utf-8", "surrogatepass"))
        if kind == "email":
            local, _, domain = word.partition("@")
            at, dot = ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "))[style % 3]
            form, loose = local + at + domain.replace(".", dot), "mail_words"
        elif kind == "phone":
            local = re.sub(r"^\+[0-9]+[ .-]*", "", word)
            form, loose = (word[1:], local, " ".join(re.findall(r"[0-9]+", local)), ".-"[style >> 2 & 1].join(re.findall(r"[0-9]+", local)))[style % 4], "phone_loose"
        else:
            continue
        before, after = text[max(0, start - 60) : start], text[end : end + 60]
        new = before + form + after
        lo, hi = len(before), len(before) + len(form)
        out += [(new, m.start(), m.end(), loose) for m in LOOSE[loose].finditer(new) if lo <= m.start() and m.end() <= hi and 2 * (m.end() - m.start()) > hi - lo and _decided(loose, m[0]) is not False]
    return out


#: What stands before made numbers that are personal data, and before those that are none.
WITH_CUE, WITH_OTHER = ("tel ", "phone ", "call ", "mobile: ", "contact ", ""), ("part no ", "order ", "invoice ", "serial ", "item ", "lot ", "ref ", "model ", "ticket no ", "batch ")
ORDINARY = re.compile(r"(?<![\w.@-])[^\W\d_]{2,12}(?= [^\W\d_]{2,12} [^\W\d_]{2,12}(?![\w@]))")


def made(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(text around, start, end, kind, outcome): personal data and look-alikes put among the text's own ordinary words.

    Their digits and words come from the text: numbers that stand behind words for other numbers, lists of numbers,
    years, and prose with "at" and "dot" against phone numbers, social security numbers and spelled-out addresses.
    """
    out = []
    places = list(ORDINARY.finditer(text[:20_000]))  # the fit's sample takes few places of a text
    for k, m in enumerate(places[:: max(1, len(places) // 3)][:3]):
        first, second, third = text[m.start() : m.start() + 60].split(" ")[:3]
        style = crc32(text[m.start() : m.start() + 40].encode("utf-8", "surrogatepass"))
        d = lambda n, at: str((style >> at) % 9 + 1) + f"{style * (at + 7) % 10**9:09d}"[: n - 1]
        sep, cue, other = "- ."[style % 3], WITH_CUE[style // 3 % len(WITH_CUE)], WITH_OTHER[style // 7 % len(WITH_OTHER)]
        phone = (f"({d(3, 1)}) {d(3, 2)}-{d(4, 3)}", f"{d(3, 1)}{sep}{d(3, 2)}{sep}{d(4, 3)}", f"1{sep}{d(3, 1)}{sep}{d(3, 2)}{sep}{d(4, 3)}", f"0{d(2, 4)} {d(3, 1)} {d(4, 3)}")[style // 11 % 4]
        step = 10 ** (style % 3) * (style % 7 + 1)
        listed = [str(int(d(4, 5)) // 100 * 100 + step * i) for i in range(3 + style % 2)]
        groups = (d(4, 1), d(4, 2), d(4, 3)) if style % 2 else (d(2, 1), d(4, 2), d(4, 3))
        years = " ".join(str(1950 + (style >> i) % 75) for i in (0, 4, 9))
        ssn = f"{style % 600 + 100}-{style // 5 % 89 + 10}-{style // 3 % 8999 + 1000}"
        at, dot = ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "))[style // 13 % 3]
        end = ("com", "org", "net", "de")[style // 17 % 4]
        name = (f"{first}.{second}", f"{first}{style % 90 + 10}", f"{first[:1]}_{second}", first)[min(style // 19 % 4, 3 if at != " at " else 2)]
        forms = [
            (cue, phone, "phone_loose", True), (other, phone if "(" not in phone else f"{d(3, 1)}-{d(3, 2)}-{d(4, 3)}", "phone_loose", False), (("", "were ", "of ")[style % 3], " ".join(listed), "phone_loose", False),
            (other if style % 3 else "", sep.join(groups), "phone_loose", False), ("", years, "phone_loose", False), (("ssn ", "", "social security ")[style % 3], ssn, "ssn", True), (other, ssn, "ssn", False),
            ("", name + at + third + dot + end, "mail_words", True), ("", f"{first} at {second} dot {third}", "mail_words", False), ("", f"{first} (at) {second} dot {end}", "mail_words", False), ("", f"{first} at {second} dot {end}", "mail_words", False),
        ]
        before, after = text[max(0, m.start() - 60) : m.start()], " " + text[m.end() + 1 : m.end() + 60]
        for lead, form, kind, outcome in forms[k % 2 :: 2] if k else forms:
            new, lo = before + lead + form + after, len(before) + len(lead)
            hi = lo + len(form)
            out += [(new, f.start(), f.end(), kind, outcome) for f in LOOSE[kind].finditer(new) if lo <= f.start() and f.end() <= hi and 2 * (f.end() - f.start()) > hi - lo and _decided(kind, f[0]) is not False]
    return out


def describe(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span, with the checks of the kinds that have some, and of the text around it."""
    word, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    digits = len(DIGITS.findall(word))
    groups, mail = re.findall(r"[0-9]+", word), kind == "mail_words"
    sizes = sorted(map(len, groups)) or [0]
    cue = [c.strip(":.,#()") for c in before.lower().split()[-3:]]
    local = re.match(r"[A-Za-z0-9._%+-]*", word)[0] if mail else ""
    return [
        *(float(kind == k) for k in EXTRA),
        float(mail and "(" in word), float(mail and "[" in word), float(mail and " dot " in word), float(mail and " at " in word), float(". " in word), len(word), digits, len(groups), sizes[-1], sizes[0],
        float(len(groups) > 1 and sizes[0] == sizes[-1]), sum(g.endswith("00") for g in groups), float(groups == sorted(groups)), sum(g[:2] in ("19", "20") and len(g) == 4 for g in groups), len(groups[0]) if groups else 0,
        sum(c.isalpha() for c in word), sum(c.isupper() for c in word), word.count("-"), word.count("."), word.count(" "), word.count("("), word.count("@"),
        len(local), float(any(not c.isalpha() for c in local)), float(mail and word.lower().rpartition(" ")[2].rpartition("]")[2].rpartition(".")[2] in ENDS),
        len(set(word)), float(word[:1] == "+"), float(word[:1] == "("),
        float(before[-1:] in ("", " ", "\n", ":", "=")), float(after[:1] in ("", " ", "\n", ",", ".", ";")), float(before[-2:-1] == ":"),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        float(any(c in CUES[:5] for c in cue)), float(any(c in CUES for c in cue)), float(any(c in OTHER_NUMBERS for c in cue)),
    ]


class Trees:
    """Gradient-boosted trees with logistic loss on binned features, plus a logistic calibration of their margin."""

    ROUNDS, DEPTH, RATE, BINS, RIDGE = 40, 3, 0.2, 16, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        hold = np.arange(len(y)) % 4 == 3
        self.cuts = [self._cuts(np.unique(c)) for c in x.T]
        b = self._bin(x)
        p0 = np.clip(y[~hold].mean(), 0.01, 0.99)
        self.start, self.trees = float(np.log(p0 / (1 - p0))), []
        margin = np.full(len(y), self.start)
        for _ in range(self.ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(b, np.where(hold, 0, p - y), np.where(hold, 0, p * (1 - p)), np.arange(len(y)), self.DEPTH)
            self.trees.append(tree)
            margin += self.RATE * self._walk(tree, b)
        self.scale, self.shift = 1.0, 0.0
        for _ in range(200):  # logistic calibration on the rows left out
            p = 1 / (1 + np.exp(-(self.scale * margin[hold] + self.shift)))
            g = p - y[hold]
            self.scale -= 0.05 * ((g * margin[hold]).mean() + 0.01 * (self.scale - 1))
            self.shift -= 0.05 * g.mean()
        return self

    def _cuts(self, values: np.ndarray) -> np.ndarray:
        """Bounds between distinct values, so that rare ones keep a bin of their own as long as bins last."""
        return values[1:] if len(values) <= self.BINS else np.unique(np.quantile(values, np.linspace(0, 1, self.BINS + 1)[1:-1]))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)], axis=1)

    def _grow(self, b, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = -gs / (hs + self.RIDGE)
        if not depth:
            return leaf
        best = (1e-6, None, None)
        for f in range(b.shape[1]):
            gl = np.cumsum(np.bincount(b[rows, f], g[rows], self.BINS + 1))[:-1]
            hl = np.cumsum(np.bincount(b[rows, f], h[rows], self.BINS + 1))[:-1]
            gain = gl**2 / (hl + self.RIDGE) + (gs - gl) ** 2 / (hs - hl + self.RIDGE) - gs**2 / (hs + self.RIDGE)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] is None:
            return leaf
        left = b[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1)

    def _walk(self, tree, b):
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        f, k, left, right = tree
        return np.where(b[:, f] <= k, self._walk(left, b), self._walk(right, b))

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        margin = self.start + self.RATE * sum(self._walk(t, b) for t in self.trees)
        return 1 / (1 + np.exp(-(self.scale * margin + self.shift)))


#: Held-out candidates of a kind below which its threshold comes from all kinds together.
FEW = 20


class Selector:
    """Trees over extra candidates and the least probability with which each kind is kept; what a checksum proves is kept by itself."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kinds: np.ndarray):
        self.trees = Trees().fit(x, y)
        hold = np.arange(len(y)) % 4 == 3
        p, right, of = self.trees.probability(x[hold]), y[hold], kinds[hold]
        pooled = self._least(p, right)
        enough = lambda k: (of == k).sum() >= FEW and right[of == k].any()
        self.least = {k: self._least(p[of == k], right[of == k]) if enough(k) else pooled for k in EXTRA}

    @staticmethod
    def _least(p: np.ndarray, y: np.ndarray) -> float:
        """The least probability down to which at least ``PRECISION`` of the candidates are right; beyond 1 where there is none."""
        order = np.argsort(-p, kind="stable")
        p, right = p[order], np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        last = np.append(p[1:] < p[:-1], True)  # a threshold takes all equal probabilities
        good = np.flatnonzero(last & (right >= PRECISION))
        if not len(good):
            return 2.0
        lower = p[good[-1] + 1] if good[-1] + 1 < len(p) else max(0.0, 2 * p[good[-1]] - 1)
        return float((p[good[-1]] + lower) / 2)

    def keep(self, text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        p = self.trees.probability(np.array([describe(text, *s) for s in spans]))
        return [s for s, q in zip(spans, p) if s[2] == "iban" or q >= self.least[s[2]]]


def decided_rows(text: str, every: int = 1) -> list[tuple[str, bool, list[float], str]]:
    """(kind, outcome, features, surroundings) of the candidates of a text that something decides, and of those made in one of ``every`` texts."""
    base = base_spans(text)
    out = [(k, ok, describe(text, s, e, k), text[max(0, s - 20) : e + 20]) for s, e, k, ok in extras(text, base) if ok is not None]
    out += [(k, True, describe(t, s, e, k), t) for t, s, e, k in rewritten(text, base)]
    if crc32(text.encode("utf-8", "surrogatepass")) % every:
        return out
    return out + [(k, ok, describe(t, s, e, k), t) for t, s, e, k, ok in made(text)]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Selector | None:
    """A selector from the decided candidates of sampled rows; None without both outcomes."""
    small_batches(df.sparkSession)
    every = max(1, min(df.count(), 2 * FIT_ROWS) // (2 * FIT_SPANS))  # a text gives some of every kind, and FIT_SPANS of each are used
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("y", T.DoubleType()), T.StructField("h", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import xxhash

        for batch in batches:
            for part in sized_slices(batch, 0):
                rows = [r for text in part.column(0).to_pylist() if text for r in decided_rows(text, every)]
                hashes = [xxhash.xxh3_64_intdigest(around.encode("utf-8", "surrogatepass")) >> 1 for *_, around in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([float(r[1]) for r in rows], pa.float64()), pa.array(hashes, pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=schema.names)

    found = hash_share(df, [id_col, text_col], FIT_ROWS, 11).select(F.col(text_col).cast("string")).mapInArrow(run, schema)
    nth = F.row_number().over(Window.partitionBy("kind", "y").orderBy("h", "x"))
    rows = found.withColumn("nth", nth).filter(F.col("nth") <= FIT_SPANS).orderBy("h", "kind", "y", "x").select("kind", "y", "x").toArrow()  # at most FIT_SPANS per kind and outcome
    y = rows["y"].to_numpy()
    if len(y) < 8 or not 0 < y.mean() < 1:
        return None
    x = np.array(rows["x"].to_pylist())
    return Selector(x, y, np.array(rows["kind"].to_pylist()))


def pii_spans(text: str, selector: Selector | None) -> list[tuple[int, int, str]]:
    """Base spans, then the extra spans that the selector keeps, by kind as listed and then start."""
    base = base_spans(text)
    extra = [c[:3] for c in extras(text, base) if c[3] is not False] if selector is not None else []
    return base + sorted(selector.keep(text, extra), key=lambda s: (KINDS.index(s[2]), s[0])) if extra else base


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def find_pii(df: DataFrame, selector: Selector | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id and ``spans``, an array of (kind, start, end) by kind as listed and start."""
    shared = df.sparkSession.sparkContext.broadcast(selector)  # 40 trees of 8 leaves and four thresholds

    def make():
        t = shared.value
        return lambda texts: [[[{"kind": k, "start": s, "end": e} for s, e, k in pii_spans(x, t)] if x else [] for x in texts]]

    return map_texts(df, make, [("spans", T.ArrayType(SPAN))], id_col, text_col)


def pii_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit, find, and return counts of the base kinds, the digest of the base spans and all spans as text."""
    found = find_pii(df, fit(df, id_col, text_col), id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
