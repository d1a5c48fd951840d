"""Alignment of two tokenizers' tokens by pointer jumping.

Both tokenizers cut the same bytes. Every token points to the farthest-right token that overlaps it
(itself where nothing reaches farther), and doubling the pointers of a whole slice of texts at once leads
every token to the last one of its component. Components are the groups: they end where a token
of A and a token of B end together, and such a pair is a link.

Plan: one pass tokenizes, aligns and writes per document its counts, the digest of its groups and
its distinct links, packed. Links are counted under partial aggregation (tasks add up their own
first), and the highest count of each B id is found. A table of up to ``BROADCAST_PAIRS`` pairs is
broadcast and looked up where the packed links are read; a larger one is joined, frequent pairs
split by salts. Texts are read once and never shuffled.

Token ids of A come from the rank form of its vocabulary where the file shows that ids are ranks and
that it splits by ``PATTERN`` (then the result is the same and takes a third of the time), else from the
tokenizers library. B is cut at blanks before words where no piece reaches across one, so that a word
is encoded once in a task; else whole texts are encoded.

Defined cases: texts that are null or empty, or whose tokens do not give back the bytes of a blank
and the text in either tokenizer, have no tokens: zeros and an empty digest; every row counts for
itself, also those that share an id or have none; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain
from re import compile as pattern

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .textops import map_texts, spread_join, write_table

SLICE = 1 << 20  # bytes of text that are tokenized at a time
WORD_CHARS = 4_000_000  # characters of words that a task keeps between slices
BROADCAST_PAIRS = 4_000_000  # pairs (17 bytes each) up to which their counts are broadcast
PAIR_ROWS = 1 << 22  # links that a task adds up at a time
WORD = pattern(r" +[^ ]*")
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids of texts and bytes of ids by a byte-level vocabulary in the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes = [b""] * (max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1)
        for entry, i in vocab.items():
            self.bytes[i] = bytes(map(letters.__getitem__, entry))
        cut = spec.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        ranked = all(vocab.get(m.replace(" ", "")) == 256 + i for i, m in enumerate(merges)) and len(vocab) == 256 + len(merges)
        plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        if ranked and plain and not spec["model"].get("ignore_merges"):
            import tiktoken

            ranks = {self.bytes[i]: i for i in vocab.values()}
            self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            self.encode = lambda t: model.encode(t, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> list[list[int]]:
        """``texts`` begin with the blank."""
        return list(map(self.encode, texts))


class Pieces:
    """Ids of texts and bytes of ids by a model of pieces that adds a blank in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        blank = self.model.piece_to_id(SPACE)
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in names) and not self.model.is_unknown(blank)  # no merge joins a blank to what stands before it
        self.last = {" ": [blank]}  # a blank at the end, for which the model would see no text
        self.kept: dict[str, list[int]] = {}
        self.held = 0

    def __call__(self, texts: list[str]) -> list[list[int]]:
        """``texts`` begin with the blank, which the model adds by itself."""
        if not self.by_word:
            return self.model.encode([t[1:] for t in texts], num_threads=1)
        if self.held > WORD_CHARS:
            self.kept.clear()
            self.held = 0
        words = [WORD.findall(t) for t in texts]
        new = list(set(chain.from_iterable(words)).difference(self.kept))
        self.held += sum(map(len, new))
        self.kept.update(zip(new, self.model.encode([w[1:] for w in new], num_threads=1)))
        self.kept.update(self.last)
        return [list(chain.from_iterable(map(self.kept.__getitem__, w))) for w in words]


def last_tokens(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A and each B token the number of the B token that ends its component.

    ``a_end`` and ``b_end`` are the ends of tokens that cover the same bytes; none is empty.
    """
    n = len(a_end)
    to_b = n + np.searchsorted(b_end, a_end)  # the token that holds the last byte reaches farthest
    to_a = np.searchsorted(a_end, b_end)
    farther = a_end[to_a] > b_end if n else np.empty(0, bool)
    points = np.concatenate([to_b, np.where(farther, to_a, n + np.arange(len(b_end)))]).astype(np.int64)
    while True:
        jumped = points[points]
        if np.array_equal(jumped, points):
            return points[:n] - n, points[n:] - n
        points = jumped


class Aligner:
    """Aligned tokens of texts; built once in a task."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))
        numbers = lambda t, end: np.array([f"{i}{end}" for i in range(len(t.bytes))], object)
        self.words = [numbers(self.a, ","), numbers(self.a, "|"), numbers(self.b, ","), numbers(self.b, ";")]
        self.code = "<u4" if len(self.a.bytes) * len(self.b.bytes) < 1 << 32 else "<u8"

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B; empty where a text has no tokens."""
        spaced = [" " + t for t in texts if t]
        pairs = iter(list(zip(spaced, self.a(spaced), self.b(spaced))))
        out = []
        for t in texts:
            whole, a, b = next(pairs) if t else ("", [], [])
            raw = whole.encode("utf-8", "surrogatepass")
            same = b"".join(map(self.a.bytes.__getitem__, a)) == raw and b"".join(map(self.b.bytes.__getitem__, b)) == raw
            out.append((a, b) if same else ([], []))
        return out

    def __call__(self, texts: list[str | None]) -> list[list]:
        """Columns n_a, n_b, n_groups, n_links, groups_sha256, codes, times."""
        each = self.tokens(texts)
        n_a, n_b = (np.array([len(x[k]) for x in each]) for k in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(x[k] for x in each), np.int64) for k in (0, 1))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_last, b_last = last_tokens(a_end, b_end)
        ends = np.flatnonzero(b_last == np.arange(len(b)))  # the B token that ends each group; A's ends there too
        partner = np.searchsorted(a_end, b_end[ends])
        doc = np.searchsorted(np.cumsum(n_b), ends, "right")
        groups = np.bincount(doc, minlength=len(texts))
        # every group's A ids, then its B ids
        line = np.empty(len(a) + len(b), object)
        a_group, b_group = np.searchsorted(ends, a_last), np.searchsorted(ends, b_last)
        a_final, b_final = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_final[partner], b_final[ends] = True, True
        line[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = np.where(a_final, self.words[1][a], self.words[0][a])
        line[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = np.where(b_final, self.words[3][b], self.words[2][b])
        cuts = np.concatenate([[0], np.cumsum(n_a + n_b)])
        shas = [hashlib.sha256("".join(line[lo:hi].tolist())[:-1].encode()).hexdigest() if hi > lo else "" for lo, hi in zip(cuts[:-1], cuts[1:])]
        links = a[partner] * len(self.b.bytes) + b[ends]
        order = np.lexsort((links, doc))
        links, of = links[order], doc[order]
        starts = np.flatnonzero(np.r_[True, (links[1:] != links[:-1]) | (of[1:] != of[:-1])]) if len(links) else np.empty(0, np.int64)
        times = np.diff(np.r_[starts, len(links)]) if len(links) else starts
        at = np.concatenate([[0], np.cumsum(np.bincount(of[starts], minlength=len(texts)))])
        codes, times = links[starts].astype(self.code), times.astype("<u4")
        packed = [[x[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:])] for x in (codes, times)]
        return [n_a.tolist(), n_b.tolist(), groups.tolist(), groups.tolist(), shas, *packed]


def aligned(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, groups_sha256 and its distinct links (codes, times, packed)."""
    columns = [(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", T.StringType()), ("codes", T.BinaryType()), ("times", T.BinaryType())]
    return map_texts(df, lambda: Aligner(a_path, b_path), columns, id_col, text_col, SLICE)


def group_table(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id and groups, an array of (a_ids, b_ids)."""
    ids = T.ArrayType(T.IntegerType())
    kind = T.ArrayType(T.StructType([T.StructField("a_ids", ids), T.StructField("b_ids", ids)]))

    def make():
        aligner = Aligner(a_path, b_path)

        def run(texts):
            out = []
            for a, b in aligner.tokens(texts):
                a_last, b_last = last_tokens(np.cumsum(aligner.a_size[np.array(a, np.int64)]), np.cumsum(aligner.b_size[np.array(b, np.int64)]))
                ends = np.flatnonzero(b_last == np.arange(len(b)))
                a_cut, b_cut = (np.r_[0, np.searchsorted(x, ends, "right")] for x in (a_last, b_last))
                out.append([{"a_ids": a[i:j], "b_ids": b[k:m]} for i, j, k, m in zip(a_cut[:-1], a_cut[1:], b_cut[:-1], b_cut[1:])])
            return [out]

        return run

    return map_texts(df, make, [("groups", kind)], id_col, text_col, SLICE)


def pair_counts(links: DataFrame, code: str, b_ids: int) -> DataFrame:
    """(code, n, best): how many links hold each id pair, and whether no pair of its B id has more."""
    schema = T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def add(batches):
        held, rows = [], 0

        def summed():
            codes, of = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.bincount(of, weights=np.concatenate([t for _, t in held]), minlength=len(codes)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], schema=arrow)

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                held.append(tuple(np.frombuffer(b"".join(part.column(k).to_pylist()), kind) for k, kind in ((0, code), (1, "<u4"))))
                rows += len(held[-1][0])
                if rows >= PAIR_ROWS:
                    yield summed()
                    held, rows = [], 0
        if rows:
            yield summed()

    counts = links.select("codes", "times").mapInArrow(add, schema).groupBy("code").agg(F.sum("n").alias("n"))
    counts = write_table(counts)
    most = counts.groupBy((F.col("code") % b_ids).alias("b")).agg(F.max("n").alias("most"))  # at most a row per B id
    return counts.join(F.broadcast(most), F.col("code") % b_ids == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(links: DataFrame, pairs: DataFrame, code: str) -> DataFrame:
    """n_best and count_sum of every row from the broadcast table of pairs."""
    table = pairs.orderBy("code").toArrow()  # BROADCAST_PAIRS rows at most
    codes, n, best = table["code"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()
    sent = links.sparkSession.sparkContext.broadcast((codes.astype(code), n, best))
    kept = [f for f in links.schema if f.name not in ("codes", "times", "row")]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        codes, n, best = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                get = lambda name: part.column(part.schema.get_field_index(name))
                mine = [np.frombuffer(x, code) for x in get("codes").to_pylist()]
                of = np.repeat(np.arange(len(mine)), [len(x) for x in mine])
                at = np.searchsorted(codes, np.concatenate(mine)) if len(of) else np.empty(0, np.int64)
                times = np.frombuffer(b"".join(get("times").to_pylist()), "<u4").astype(np.int64)
                sums = []
                for value in (np.where(best[at], times, 0), n[at] * times):
                    total = np.r_[0, np.cumsum(value)]
                    cut = np.r_[0, np.cumsum(np.bincount(of, minlength=len(mine)))]
                    sums.append(pa.array(total[cut[1:]] - total[cut[:-1]], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(get(f.name) for f in kept), *sums], schema=arrow)

    return links.select(*[f.name for f in kept], "codes", "times").mapInArrow(run, schema)


def _joined(links: DataFrame, pairs: DataFrame, code: str) -> DataFrame:
    """The same by joins, for any number of pairs."""
    schema = T.StructType([T.StructField("row", T.StringType()), T.StructField("code", T.LongType()), T.StructField("times", T.LongType())])
    arrow = to_arrow_schema(schema)

    def spread(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row, codes, times = (batch.column(k)[i].as_py() for k in range(3))
                if codes:
                    c = np.frombuffer(codes, code).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(c)), pa.array(c), pa.array(np.frombuffer(times, "<u4").astype(np.int64))], schema=arrow)

    each = links.select("row", "codes", "times").mapInArrow(spread, schema)
    found = spread_join(each, pairs, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    both = links.drop("codes", "times").join(found, "row", "left").drop("row")
    return both.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def alignment(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    links = write_table(aligned(df, a_path, b_path, id_col, text_col).withColumn("row", F.uuid()))  # a name for each row, from here on fixed
    made = Aligner(a_path, b_path)
    code, b_ids = made.code, len(made.b.bytes)
    pairs = write_table(pair_counts(links, code, b_ids))
    out = (_looked_up if pairs.count() <= BROADCAST_PAIRS else _joined)(links, pairs, code)
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
