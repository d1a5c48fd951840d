"""Removal of lines that many documents share, by a sharded minimal perfect hash.

A line's key is the line without blanks at its ends and with A-Z lower-cased. Keys of at least
``MIN_CHARS`` code points count; a key found in at least ``MIN_DOCS`` documents loses all its lines except
those of the largest id that holds it.

Plan: every document gives its distinct keys as 128-bit hashes; one aggregation with partial sums
counts documents and keeps the largest id of a key, however hot it is. The frequent keys are dealt
to shards by their hash. A shard becomes a minimal perfect hash: levels of bits in each of
which a key has a bit of its own or goes on to the next level; the rank of its bit is its place in
arrays of fingerprints, counts and largest ids. Rarer keys need no place: they land on a bit that
is not set or on another fingerprint.

Documents probe the arrays. An index of up to ``BROADCAST_KEYS`` keys is broadcast and probed where
the documents are read, so that texts are never shuffled. A larger one stays in its shards: probes
are sent to the shard of their hash, split by salts where the shard's keys occur often, and
what they find goes back to the documents.

Defined cases: null and empty texts are one empty line; every row is a document, also those that
share an id, and all rows of the largest id keep a line; rows without an id come before all ids;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .textops import bounded, sized_slices, small_batches, write_shared, write_table

MIN_CHARS, MIN_DOCS = 40, 5
BLANKS = " \t\n\v\f\r"
SHARD_KEYS = 1 << 16  # keys of a shard, on average
BROADCAST_KEYS = 2_000_000  # keys (some 21 bytes each) up to which the index is broadcast
SALT_PROBES = 200_000  # probes for frequent keys that one task of a shard takes
BITS = 2  # bits of a level for each key that reaches it
LEVELS = 64
NO_ID = -(1 << 63)

SHARD = T.StructType([T.StructField("shard", T.LongType())] + [T.StructField(c, T.BinaryType()) for c in ("sizes", "bits", "marks", "counts", "lasts")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slots(high: np.ndarray, low: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """Where keys fall in a level of ``size`` bits."""
    x = _mix(high ^ _mix(low + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
    return ((x >> np.uint64(32)) * np.asarray(size, np.uint64)) >> np.uint64(32)


def build_shard(high: np.ndarray, low: np.ndarray, counts: np.ndarray, lasts: np.ndarray) -> tuple[bytes, ...]:
    """Sizes of the levels, their bits, and by rank the fingerprints, counts and largest ids of distinct keys."""
    sizes, bits, order = [], [], []
    left = np.arange(len(high))
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError(f"{len(left)} keys do not part in {LEVELS} levels; keys must be distinct")
        size = -(-BITS * len(left) // 64) * 64
        at = _slots(high[left], low[left], len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        order.append(left[mine][np.argsort(at[mine])])
        bits.append(np.packbits(alone, bitorder="little"))
        sizes.append(size)
        left = left[~mine]
    order = np.concatenate(order) if order else left
    parts = (np.array(sizes, "<i8"), np.concatenate(bits or [np.empty(0, np.uint8)]), low[order].astype("<u8"), np.minimum(counts[order], 0xFFFFFFFF).astype("<u4"), lasts[order].astype("<i8"))
    return tuple(p.tobytes() for p in parts)


class LineIndex:
    """Shards side by side: one array of bits, of ranks, fingerprints, counts and largest ids.

    ``shards`` are tuples as ``build_shard`` makes them, in order from ``first``, of ``total`` in all.
    """

    def __init__(self, shards: list[tuple[bytes, ...]], total: int | None = None, first: int = 0):
        self.total, self.first = total or max(1, len(shards)), first
        each = [np.frombuffer(s[0], "<i8") for s in shards] or [np.empty(0, np.int64)]
        self.sizes = np.zeros((max(map(len, each)), len(each)), np.int64)  # by level and shard
        for k, s in enumerate(each):
            self.sizes[: len(s), k] = s
        by_shard = self.sizes.T.ravel()  # the order of the bits
        self.starts = (np.cumsum(by_shard) - by_shard).reshape(len(each), -1).T
        self.words = np.frombuffer(b"".join(s[1] for s in shards), "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones
        self.marks = np.frombuffer(b"".join(s[2] for s in shards), "<u8")
        self.counts = np.frombuffer(b"".join(s[3] for s in shards), "<u4")
        self.lasts = np.frombuffer(b"".join(s[4] for s in shards), "<i8")

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Places of keys in the arrays; -1 for a key that is not in the index."""
        out = np.full(len(high), -1)
        if not len(self.marks):
            return out
        shard = shard_of(high, self.total) - self.first
        left = np.arange(len(high))
        for level in range(len(self.sizes)):
            size = self.sizes[level, shard[left]]
            left = left[size > 0]
            if not len(left):
                break
            at = self.starts[level, shard[left]] + _slots(high[left], low[left], level, size[size > 0]).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            rank = self.ranks[at[hit] >> 6] + np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            same = self.marks[rank] == low[left[hit]]
            out[left[hit][same]] = rank[same]
            left = left[~hit]
        return out


def shard_of(high: np.ndarray, total: int) -> np.ndarray:
    return ((high >> np.uint64(32)) * np.uint64(total) >> np.uint64(32)).astype(np.int64)


def line_keys(text: str | None, least: int = MIN_CHARS) -> tuple[list[str], list[bytes | None]]:
    """The lines of a text and the 128-bit hash of each one's key; null where the key is too short to count."""
    lines, keys = (text or "").split("\n"), []
    for line in lines:
        key = line.strip(BLANKS) if len(line) >= least else ""
        keys.append(xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= least else None)  # bytes: ASCII letters only
    return lines, keys


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _runs(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``run`` over slices of bounded size of the rows (id, text, ...)."""
    small_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized_slices(batch, 1):
                yield run(part)

    return df.mapInArrow(each, schema)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def line_counts(df: DataFrame, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(high, low, n, last): the hash of every distinct key, the number of documents with it and their largest id."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("high", "low", "id")])
    arrow = to_arrow_schema(schema)

    def run(part):
        high, low, owner = [], [], []
        for of, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if keys := {k for k in line_keys(text, least)[1] if k}:
                h, w = _halves(list(keys))
                high.append(h)
                low.append(w)
                owner.append(np.full(len(h), NO_ID if of is None else of))
        arrays = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (high, low, owner)]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=arrow)

    return _runs(_texts(df, id_col, text_col), run, schema).groupBy("high", "low").agg(F.count("*").alias("n"), F.max("id").alias("last"))


def _shard(high: Column, total: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(high, 32) * total, 32).alias("shard")


def build_index(counts: DataFrame, total: int) -> DataFrame:
    """One row per shard (``SHARD``) of the keys in ``counts``; shards without keys have none."""
    arrow = to_arrow_schema(SHARD)

    def run(table: pa.Table) -> pa.Table:
        high, low, n, last = (table[c].to_numpy() for c in ("high", "low", "n", "last"))
        made = build_shard(high.view(np.uint64), low.view(np.uint64), n, last)
        return pa.Table.from_arrays([pa.array([table["shard"][0].as_py()], pa.int64()), *[pa.array([x], pa.binary()) for x in made]], schema=arrow)

    return counts.withColumn("shard", _shard(F.col("high"), total)).groupBy("shard").applyInArrow(run, SHARD)


def _kept(lines: list[str], drop: list[bool]) -> str:
    return "\n".join(line for line, d in zip(lines, drop) if not d)


def _results(part: pa.RecordBatch, lines: list, drops: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = [part.column(0), pa.array([len(x) for x in lines], pa.int64()), pa.array([sum(d) for d in drops], pa.int64()), pa.array([_kept(x, d) for x, d in zip(lines, drops)], pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _probe_here(docs: DataFrame, shards: DataFrame, total: int, least: int, min_docs: int, schema: T.StructType) -> DataFrame:
    """Documents probe a broadcast index."""
    rows = {r[0]: tuple(map(bytes, r[1:])) for r in shards.collect()}  # BROADCAST_KEYS keys at most
    none = build_shard(*[np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64)])
    sent = docs.sparkSession.sparkContext.broadcast([rows.get(k, none) for k in range(total)])
    arrow, held = to_arrow_schema(schema), []

    def run(part):
        if not held:
            held.append(LineIndex(sent.value))
        index = held[0]
        ids = [NO_ID if i is None else i for i in part.column(0).to_pylist()]
        split = [line_keys(t, least) for t in part.column(1).to_pylist()]
        high, low = _halves([k for _, keys in split for k in keys if k])
        at = index.find(high, low)
        of = np.repeat(ids, [sum(k is not None for k in keys) for _, keys in split]).astype(np.int64)
        found = at >= 0
        found[found] = (index.counts[at[found]] >= min_docs) & (index.lasts[at[found]] != of[found])
        answer = iter(found.tolist())
        return _results(part, [x for x, _ in split], [[k is not None and next(answer) for k in keys] for _, keys in split], arrow)

    return _runs(docs, run, schema)


def _probe_there(docs: DataFrame, shards: DataFrame, counts: DataFrame, total: int, least: int, min_docs: int, schema: T.StructType) -> DataFrame:
    """Probes go to the shards, and the keys to drop come back to their documents."""
    asks = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "mark", "high", "low")])
    ask_schema = to_arrow_schema(asks)

    def ask(part):
        out = [[], [], [], []]
        for i, text, mark in zip(*(c.to_pylist() for c in part.columns)):
            if keys := {k for k in line_keys(text, least)[1] if k}:
                h, w = _halves(list(keys))
                for column, x in zip(out, (np.full(len(h), NO_ID if i is None else i), np.full(len(h), mark), h, w)):
                    column.append(x.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in out], schema=ask_schema)

    # the id and the hash of the text name a document; rows equal in both fare alike
    marked = docs.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    probes = _runs(marked, ask, asks).withColumn("shard", _shard(F.col("high"), total))
    hot = bounded(write_shared(counts.groupBy(_shard(F.col("high"), total)).agg(F.ceil(F.sum("n") / SALT_PROBES).cast("long").alias("salts"))))
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id", "mark"), F.col("salts"))).otherwise(0).cast("long").alias("salt")
    sent = probes.join(hot, "shard").select("shard", salt, *asks.names)
    copies = shards.join(hot, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    both = sent.unionByName(copies, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("sizes").isNull())
    found = T.StructType([T.StructField("id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("key", T.BinaryType())])
    found_schema = to_arrow_schema(found)

    def meet(batches):
        index = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            starts = np.flatnonzero(~table["sizes"].is_null().to_numpy())  # rows of the index come before their probes
            cuts = sorted({0, *starts.tolist(), batch.num_rows})
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = table.slice(lo, hi - lo)
                if lo in starts:
                    index = LineIndex([tuple(part[c][0].as_py() for c in SHARD.names[1:])], total, part["shard"][0].as_py())
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                ids, mark, high, low = (part[c].to_numpy() for c in asks.names)
                at = index.find(high.view(np.uint64), low.view(np.uint64))
                hit = at >= 0
                hit[hit] = (index.counts[at[hit]] >= min_docs) & (index.lasts[at[hit]] != ids[hit])
                keys = np.stack([high[hit], low[hit]], axis=1).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(mark[hit]), pa.array([k.tobytes() for k in keys], pa.binary())], schema=found_schema)

    drops = both.mapInArrow(meet, found).distinct().groupBy("id", "mark").agg(F.collect_list("key").alias("keys"))
    named = marked.withColumn("own", F.coalesce("id", F.lit(NO_ID)))
    whole = named.join(drops.toDF("own", "mark", "keys"), ["own", "mark"], "left").select("id", "text", "keys")
    arrow = to_arrow_schema(schema)

    def run(part):
        split = [line_keys(t, least) for t in part.column(1).to_pylist()]
        gone = [set(k or ()) for k in part.column(2).to_pylist()]
        return _results(part, [x for x, _ in split], [[k in g for k in keys] for (_, keys), g in zip(split, gone)], arrow)

    return _runs(whole, run, schema)


def dedup_lines(df: DataFrame, least: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id (long), n_lines, n_dropped and kept_text, the lines that stay."""
    docs = _texts(df, id_col, text_col)
    counts = write_table(line_counts(df, least, id_col, text_col).filter(F.col("n") >= min_docs))
    keys = counts.count()
    total = max(1, -(-keys // SHARD_KEYS))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    if keys <= BROADCAST_KEYS:
        out = _probe_here(docs, build_index(counts, total), total, least, min_docs, schema)
    else:
        out = _probe_there(docs, write_table(build_index(counts, total)), counts, total, least, min_docs, schema)
    return out.withColumnRenamed("id", id_col)


def line_digests(df: DataFrame, least: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup_lines`` with kept_sha256 (lowercase hex of the kept text in UTF-8) in place of the text."""
    return dedup_lines(df, least, min_docs, id_col, text_col).withColumn("kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256)).drop("kept_text")
