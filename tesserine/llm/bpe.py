"""Byte-level BPE by recursive DuckDB queries inside each partition.

The texts of a slice are cut by the tokenizer's pattern; pieces that the vocabulary holds whole
are one token, the other distinct pieces become token-position rows. A recursive query joins
neighbours with the merge table and contracts, per piece and round, the leftmost pair of
minimum rank until no pair is left. Token sequences of pieces are kept for the next slices of
the same worker, in two tables of bounded size. Decoding joins the ids with the vocabulary
in their order; a text is a range of the joined bytes.

Long pieces would need a round per contraction, so for them a round takes several contractions
of the plain order at once. That this changes nothing: let k be the minimum rank among a piece's
adjacent pairs and m its token. Contracting the leftmost pair of rank k removes pairs and adds
only pairs that have m as a part. A round is widened only where every token of which m is a part
has a higher rank than m ("safe"); then no added pair has a rank of k or less, so the next pair
of the plain order is the next one of rank k that does not overlap with one already contracted.
In a run of overlapping pairs these are the first, third, and so on. Where m isn't safe, the
round contracts the leftmost pair alone, but only chunks that seams could not settle are that long.

A piece of more than ``LONG`` bytes is cut into chunks that are contracted apart, and then joined at the
seams. A sequence of tokens is the result of the plain order exactly if each two neighbours are,
contracted by themselves, those same two tokens: as long as no contraction crosses a border, those
on either side of it come in the order that their two tokens alone would have, since each is
the least of all when its turn comes; so the first that would cross a border would do so with
these two tokens alone, and the other way round. Neighbours inside a chunk thus fit; those at
seams are tried, and where they don't fit the tokens around the seam are contracted again as one
chunk, with twice as many tokens each time, in the worst case the whole piece.

Memory is bounded by bytes: a query holds at most ``BLOCK`` bytes of pieces (or one piece) times
the rounds that it may run, and nothing spills to local disk.

Defined cases: a null text counts as empty and has no tokens; equal texts have equal tokens; a
null id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import map_texts

#: Pieces in either of the two tables of kept token sequences (about 200 bytes each).
KEPT_PIECES = 200_000
#: Bytes of text in a slice, bytes of pieces in one recursive query, and the length from which a piece counts as long.
SLICE, BLOCK, LONG = 2 << 20, 1 << 18, 128
#: Rounds of one recursive query; unfinished pieces start the next query where they stand.
ROUNDS = 12
#: Tokens that one decoding query joins.
DECODED = 200_000
#: DuckDB's memory: a floor, and bytes per row of a query (for single pieces larger than a block).
FLOOR_MB, ROW_BYTES = 192, 600

#: One contraction per piece and round. A row is a token with its right neighbour and the key of their pair, (rank,
#: position); the least key of a piece is contracted, and only the two pairs beside it meet the merge table again.
SHORT = """
  WITH RECURSIVE t(round, w, pos, npos, id, nid, k) AS (
    SELECT 0, s.w, s.pos, s.pos + 1, s.id, s.nid, m.id::BIGINT << 32 | s.pos FROM seed s LEFT JOIN merges m ON m.l = s.id AND m.r = s.nid
    UNION ALL
    SELECT round, w, pos, npos, u.id, nid, CASE WHEN changed THEN m.id::BIGINT << 32 | pos ELSE k END
    FROM (
      SELECT t.round + 1 AS round, t.w, t.pos, t.k, t.pos = g.pos OR t.npos = g.pos AS changed,
        CASE WHEN t.pos = g.pos THEN g.gone_npos ELSE t.npos END AS npos,
        CASE WHEN t.pos = g.pos THEN g.mid ELSE t.id END AS id,
        CASE WHEN t.pos = g.pos THEN g.gone_nid WHEN t.npos = g.pos THEN g.mid ELSE t.nid END AS nid
      FROM t JOIN (
        SELECT h.w, h.k & 4294967295 AS pos, (h.k >> 32)::INT AS mid, h.gone, x.npos AS gone_npos, x.nid AS gone_nid
        FROM (SELECT w, min(k) AS k, arg_min(npos, k) AS gone FROM t GROUP BY w HAVING min(k) IS NOT NULL) h
        JOIN t x ON x.w = h.w AND x.pos = h.gone) g ON g.w = t.w
      WHERE t.pos <> g.gone AND t.round < $rounds) u
    LEFT JOIN merges m ON changed AND m.l = u.id AND m.r = u.nid)
"""

#: All contractions of the minimum rank where it is safe: in each run of overlapping pairs the first, third, ...
LONG_ROUNDS = """
  WITH RECURSIVE t(round, w, pos, id) AS (
    SELECT 0, w, pos, id FROM seed
    UNION ALL
    SELECT round + 1, w, pos, CASE WHEN hit THEN mid ELSE id END FROM (
      SELECT *, lag(hit, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone FROM (
        SELECT *, coalesce(mid = best >> 32 AND (pos = best & 4294967295 OR safe AND (nth - other) % 2 = 1), false) AS hit FROM (
          SELECT *, coalesce(max(CASE WHEN mid IS NULL OR mid <> best >> 32 THEN nth END) OVER (PARTITION BY w ORDER BY pos), 0) AS other FROM (
            SELECT *, min(mid::BIGINT << 32 | pos) OVER (PARTITION BY w) AS best, row_number() OVER (PARTITION BY w ORDER BY pos) AS nth FROM (
              SELECT q.*, m.id AS mid, m.safe
              FROM (SELECT *, lead(id) OVER (PARTITION BY w ORDER BY pos) AS nid FROM t) q LEFT JOIN merges m ON m.l = q.id AND m.r = q.nid))
          WHERE best IS NOT NULL AND round < $rounds)))
    WHERE NOT gone)
"""

#: The tokens of each piece after its last round, piece by piece in order.
LAST = """
  SELECT t.w AS w, t.round AS round, t.id AS id
  FROM t JOIN (SELECT w, max(round) AS last FROM t GROUP BY w) z ON z.w = t.w AND z.last = t.round
  ORDER BY t.w, t.pos
"""

#: The bytes of each token in order; texts are ranges of positions.
DECODE = "SELECT v.chars AS chars FROM toks JOIN vocab v USING (id) ORDER BY pos"
#: Classes of a pattern's letters and numbers among the first 128 characters.
ASCII_CLASSES = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The same cuts of texts that are ASCII alone, for the faster package; None where a pattern has what it may read otherwise."""
    out = re.sub(r"\[[^\]]*\]", lambda m: reduce(lambda c, k: c.replace(*k), ASCII_CLASSES.items(), m[0]), pattern)
    for name, letters in ASCII_CLASSES.items():
        out = out.replace(name, f"[{letters}]")
    known = re.fullmatch(r"(?:[\w' ?+|]|\\s|\(\?!\\S\)|\[\^?(?:\\s|[A-Za-z0-9-])+\])*", out, re.A)
    return re.compile(out, re.A) if known else None


def _blocks(sizes: list[int], limit: int):
    """Consecutive ranges of about ``limit`` in total (one element at least)."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4").astype(np.int32)


class Tokenizer:
    """The vocabulary of one rank file and one DuckDB connection, for one Python worker."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern, self.plain = regex.compile(pattern), ascii_pattern(pattern)
        self.raw = {i: t for t, i in self.ranks.items()}
        self.fitting: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, ids, late = [], [], [], set()
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), ids.append(rank)
                    late.update(p for p in (a, b) if p > rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{FLOOR_MB}MB", "temp_directory": ""})
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "id": pa.array(ids, pa.int32()), "safe": pa.array([i not in late for i in ids], pa.bool_())})
        # bytes as the characters of the same numbers, so that tokens that end inside a character can be joined as text
        vocab = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "chars": pa.array([t.decode("latin-1") for t in self.ranks], pa.string())})
        for name, table in (("merges", merges), ("vocab", vocab)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _table(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        """Run a query over one given table; a table beyond the usual block gets memory in proportion."""
        large = table.num_rows * ROW_BYTES > FLOOR_MB << 20
        if large:
            self.db.execute(f"SET memory_limit = '{(table.num_rows * ROW_BYTES >> 20) + FLOOR_MB}MB'")
        self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)
            if large:
                self.db.execute(f"SET memory_limit = '{FLOOR_MB}MB'")

    def merge(self, seqs: list[np.ndarray], long: bool) -> list[np.ndarray]:
        """The fixpoint of each sequence of token ids."""
        ids, sizes = self.merge_flat(np.concatenate(seqs), np.array([len(x) for x in seqs]), long)
        return np.split(ids, np.cumsum(sizes)[:-1])

    def merge_flat(self, flat: np.ndarray, sizes: np.ndarray, long: bool) -> tuple[np.ndarray, np.ndarray]:
        """The fixpoint of sequences of token ids, which stand one after the other: all ids and the sizes."""
        w, n = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), len(sizes)
        done_w, done_id = [], []
        while len(flat):
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            pos = np.arange(len(flat)) - np.repeat(starts, np.diff(np.r_[starts, len(flat)]))
            right = np.append(flat[1:], -1)
            right[starts[1:] - 1] = -1
            seed = pa.table({"w": w, "pos": pos.astype(np.int32), "id": flat, "nid": right.astype(np.int32)})
            rounds = max(1, min(ROUNDS, ROUNDS * BLOCK // len(pos)))
            query = (LONG_ROUNDS if long else SHORT).replace("$rounds", str(rounds)) + LAST
            got = self._table(query, "seed", seed)
            w, round_, flat = (got[c].to_numpy() for c in ("w", "round", "id"))
            ended = round_ < rounds
            done_w.append(w[ended]), done_id.append(flat[ended])
            w, flat = w[~ended], flat[~ended]
        if len(done_w) == 1:
            return done_id[0], np.bincount(done_w[0], minlength=n)
        w, flat = (np.concatenate([np.empty(0, np.int32), *x]) for x in (done_w, done_id))
        order = np.argsort(w, kind="stable")
        return flat[order], np.bincount(w, minlength=n)

    def contracted(self, raws: list[bytes]) -> list[bytes]:
        """Token ids of each of some byte strings, as little-endian 32-bit integers; equal ones are contracted once."""
        done: dict[bytes, bytes] = {}
        once = list(dict.fromkeys(raws))
        for long in (False, True):
            group = [r for r in once if (len(r) > 2 * LONG) == long]
            for lo, hi in _blocks([len(r) for r in group], BLOCK):
                some = group[lo:hi]
                ids, sizes = self.merge_flat(self.of_byte[np.frombuffer(b"".join(some), np.uint8)], np.array([len(r) for r in some]), long)
                packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
                done.update(zip(some, [packed[a:b] for a, b in zip([0, *ends], ends)]))
        return [done[r] for r in raws]

    def fit(self, pairs: set[tuple[int, int]]) -> None:
        """Find out which neighbours are what the plain order makes of their bytes."""
        if len(self.fitting) > KEPT_PIECES:
            self.fitting.clear()
        new = [p for p in pairs if p not in self.fitting]
        for p, ids in zip(new, self.contracted([self.raw[a] + self.raw[b] for a, b in new])):
            self.fitting[p] = np.frombuffer(ids, "<u4").tolist() == list(p)

    def joined(self, raws: list[bytes]) -> list[np.ndarray]:
        """Token ids of long byte strings, from chunks and their seams."""
        chunks = [[r[i : i + LONG] for i in range(0, len(r), LONG)] for r in raws]
        made = map(_ids, self.contracted([c for cs in chunks for c in cs]))
        parts = [[next(made) for _ in cs] for cs in chunks]
        tokens = [np.concatenate(p) for p in parts]
        seams = [np.cumsum([len(x) for x in p])[:-1] for p in parts]
        open_, reach = list(range(len(raws))), 2
        while open_:
            near = {i: [(int(tokens[i][s - 1]), int(tokens[i][s])) for s in seams[i]] for i in open_}
            self.fit({p for ps in near.values() for p in ps})
            spans = {}  # of tokens to contract again, by piece
            for i in open_:
                bad = [int(s) for s, p in zip(seams[i], near[i]) if not self.fitting[p]]
                for s in bad:
                    lo, hi = max(0, s - reach), min(len(tokens[i]), s + reach)
                    mine = spans.setdefault(i, [])
                    if mine and mine[-1][1] >= lo:
                        mine[-1][1] = hi
                    else:
                        mine.append([lo, hi])
            again = map(_ids, self.contracted([b"".join(map(self.raw.__getitem__, tokens[i][lo:hi].tolist())) for i, ss in spans.items() for lo, hi in ss]))
            for i, ss in spans.items():
                old, out, borders, at, size = tokens[i], [], [], 0, 0
                for lo, hi in ss:
                    new = next(again)
                    out += [old[at:lo], new]
                    borders += [size + lo - at, size + lo - at + len(new)]
                    size, at = borders[-1], hi
                tokens[i] = np.concatenate([*out, old[at:]])
                seams[i] = [s for s in borders if 0 < s < len(tokens[i])]
            open_, reach = list(spans), 2 * reach
        return tokens

    def learn(self, pieces: set[str]) -> None:
        """Put the token ids of new pieces among the kept ones."""
        short, long = [], []
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                self.kept[p] = whole.to_bytes(4, "little")
            else:
                (long if len(raw) > LONG else short).append((p, raw))
        for group, method in ((short, self.contracted), (long, lambda raws: [x.astype("<u4").tobytes() for x in self.joined(raws)])):
            for lo, hi in _blocks([len(raw) for _, raw in group], BLOCK):
                self.kept.update(zip([p for p, _ in group[lo:hi]], method([raw for _, raw in group[lo:hi]])))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.kept) > KEPT_PIECES:
            self.kept, self.older = {}, self.kept
        whole, ascii_ = self.pattern.findall, (self.plain or self.pattern).findall
        cut = [(ascii_ if t.isascii() else whole)(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.kept)
        self.kept.update((p, self.older[p]) for p in new.intersection(self.older))
        self.learn(new.difference(self.older))
        kept = self.kept
        return [b"".join([kept[p] for p in pieces]) for pieces in cut]

    def forget(self) -> None:
        """Drop what was kept, at the end of a task; the vocabulary stays with the worker."""
        self.kept, self.older, self.fitting = {}, {}, {}

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each id sequence, joined in order, about ``DECODED`` ids at a time."""
        ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
        made, sizes = [], [np.zeros(1, np.int64)]
        for at in range(0, len(ids), DECODED):
            some = ids[at : at + DECODED]
            chars = self._table(DECODE, "toks", pa.table({"pos": np.arange(len(some), dtype=np.int32), "id": some}))["chars"].combine_chunks()
            bounds = np.frombuffer(chars.buffers()[1], np.int32)[chars.offset : chars.offset + len(chars) + 1]
            made.append(str(chars.buffers()[2][bounds[0] : bounds[-1]], "utf-8").encode("latin-1"))
            sizes.append(pc.utf8_length(chars).to_numpy())
        ends = np.cumsum(np.concatenate(sizes))[np.cumsum([len(e) // 4 for e in encoded], dtype=np.int64)].tolist() if encoded else []
        whole = b"".join(made)
        return [whole[a:b] for a, b in zip([0, *ends], ends)]


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(rank_file: str, pattern: str) -> Tokenizer:
    """One tokenizer per worker process, so that the vocabulary is read once."""
    if (rank_file, pattern) not in _tokenizers:
        _tokenizers[rank_file, pattern] = Tokenizer(rank_file, pattern)
    return _tokenizers[rank_file, pattern]


def encode_texts(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id and ``ids``, the token ids of the whole text."""

    def make():
        tok = tokenizer(rank_file, pattern)
        yield lambda texts: [[np.frombuffer(e, "<u4").astype(np.int32) for e in tok.encode(texts)]]
        tok.forget()

    return map_texts(df, make, [("ids", T.ArrayType(T.IntegerType()))], id_col, text_col, SLICE)


def decode_ids(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: its id and ``content``, the bytes of its token ids (null: none)."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("content", T.BinaryType())])

    def run(batches):
        tok = tokenizer(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                packed = [np.array(x or [], "<u4").tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tok.decode(packed), pa.binary())], names=schema.names)

    return df.select(id_col, F.col(ids_col).cast("array<int>")).mapInArrow(run, schema)


def token_digests(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and digest both: n_tokens, ids_sha256, decoded_sha256."""

    def make():
        tok = tokenizer(rank_file, pattern)

        def digests(texts):
            ids = tok.encode(texts)
            back = tok.decode(ids)
            sha = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs]
            return [[len(e) // 4 for e in ids], sha(ids), sha(back)]

        yield digests
        tok.forget()

    columns = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_texts(df, make, columns, id_col, text_col, SLICE)
