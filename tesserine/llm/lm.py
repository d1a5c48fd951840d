"""Language-model scores by context-tree weighting over bytes, beside a word base score.

Every byte is eight binary decisions. A node is a context of 0 to ``DEPTH`` preceding bytes with
the bits of the next byte decided so far; it holds a Krichevsky-Trofimov estimate, and each node's
weighted probability is the even mixture of its own estimate and the product of its children one
byte deeper. A prediction mixes the estimates along the path from depth 0 to the deepest node that
training has seen; the code length per byte follows.

Plan: (1) one pass turns each chunk of the input into its distinct words and its distinct grams
(context and byte) with training counts, and writes them; the grams of a chunk that share their
last two context bytes are one row of packed integers. (2) The word counts of the corpus are
summed by word. (3) Gram rows are dealt out by their two bytes, below which the tree is computed
inside the task, while the sums for depths 1 and 0 (at most 65,280 and 255 nodes) pass over the
driver. (4) A second pass over the dealt rows gives each row the log-probabilities of its grams.
(5) Chunks meet the values of their grams and words and their texts again, sorted so that a task
holds one chunk's table and streams the texts.

A gram is an integer with the nearest context byte first, so that sorted grams have their contexts
of every depth together, and nodes are runs of neighbours.

Nothing that grows with the corpus is broadcast. A chunk is a file split cut by id into pieces of
about ``CHUNK_BYTES`` of input, or a hash bucket where the rows come from no file.

Defined cases: a null text counts as empty and consists of the end alone; repeated rows repeat;
without training rows all estimates are even; a null id counts as the empty text for the split;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import sized_slices, small_batches, write_shared, write_table

#: Bytes of context (2 to 7: a gram is packed into eight bytes).
DEPTH = 5
CHUNK_BYTES = 16 << 20
HELD_GRAMS = 6 << 20  # distinct grams that a task gathers before it hands them on; a chunk then has several rows of a pair, which are summed
HELD_WORDS = 500_000  # and words
GROUPED_ROWS = 200_000  # grams that a task computes at a time, whole groups of two context bytes; a larger group is split by its next bytes
END = b"\n"  # no word
ONE, EIGHT = np.uint64(1), np.uint64(8)


def with_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id, text, held_out and chunk; a chunk's rows come from one file split where there is one."""
    conf = df.sparkSession.conf
    split = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    pieces = max(1, -(-split // CHUNK_BYTES))
    part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(pieces))
    buckets = int(conf.get("spark.sql.shuffle.partitions"))
    if not df.inputFiles():
        size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        buckets = max(buckets, -(-size // CHUNK_BYTES))
    loose = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(buckets))
    chunk = F.when(F.col("_file") == "", loose).otherwise(F.xxhash64("_file", "_block", part))
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.input_file_name().alias("_file"), F.input_file_block_start().alias("_block"))
    return named.select("id", "text", held.alias("held_out"), chunk.alias("chunk"))


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the texts, each with its end, as integers; and where each text's grams end."""
    buf = np.frombuffer(b"".join([b"\0" * DEPTH + t + b"\0" for t in texts]), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    g = np.zeros(len(buf) - DEPTH, np.uint64)
    for back in range(1, DEPTH + 1):
        g = (g << EIGHT) | buf[DEPTH - back : len(buf) - back]
    g = (g << EIGHT) | buf[DEPTH:]
    keep = np.ones(len(g), bool)
    starts = np.cumsum(sizes + DEPTH)[:-1] - DEPTH  # first start that runs into the next text
    for i in range(DEPTH):
        keep[starts + i] = False
    return g[keep], np.cumsum(sizes)


def squeezed(a: np.ndarray) -> bytes:
    """An array compressed byte plane by byte plane."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def restored(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def squeezed_grams(g: np.ndarray) -> bytes:
    return squeezed(np.diff(g, prepend=np.uint64(0)))


def restored_grams(data: bytes) -> np.ndarray:
    return np.cumsum(restored(data, np.uint64), dtype=np.uint64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    u, inverse = np.unique(k, return_inverse=True)
    return u, np.bincount(inverse, n, len(u)).astype(np.int64)


def gathered(docs: DataFrame) -> DataFrame:
    """Rows of each chunk: a word with its count in training rows (0 where only others have it), or the grams of one pair of nearest bytes with theirs."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("pair", T.IntegerType()), T.StructField("k", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("counts", T.BinaryType())])

    def chunk_rows(c: int, g: np.ndarray, n: np.ndarray, count: Counter):
        pair = (g >> np.uint64(8 * (DEPTH - 1))).astype(np.int32)
        cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(g)]
        for at in range(0, len(cuts) - 1, 500):
            some = list(zip(cuts[at : at + 501], cuts[at + 1 : at + 501]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(some), c), pa.int64()), pa.array([int(pair[a]) for a, _ in some], pa.int32()), pa.array([squeezed_grams(g[a:b]) for a, b in some], pa.binary()),
                pa.array([b - a for a, b in some], pa.int64()), pa.array([squeezed(n[a:b].astype(np.uint32)) for a, b in some], pa.binary()),
            ], names=schema.names)
        k, m = pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())
        for at in range(0, len(k), 100_000):
            size = min(100_000, len(k) - at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, c), pa.int64()), pa.array(np.full(size, -1, np.int32)), k.slice(at, size), m.slice(at, size), pa.nulls(size, pa.binary())], names=schema.names)

    def run(batches):
        grams: dict[int, list] = {}
        words: dict[int, Counter] = {}

        def told():
            for c in list(grams):
                yield from chunk_rows(c, *_summed(*grams.pop(c)), words.pop(c))

        for batch in batches:
            for part in sized_slices(batch, 1):
                chunk = part.column(0).to_numpy()
                raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in part.column(1).to_pylist()]
                held = part.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(chunk).tolist():
                    count = words.setdefault(c, Counter())
                    for out in (False, True):
                        texts = [raw[i] for i in np.flatnonzero((chunk == c) & (held == out))]
                        if not texts:
                            continue
                        g, n = np.unique(pack(texts)[0], return_counts=True)
                        have = grams.setdefault(c, [[], []])
                        have[0].append(g)
                        have[1].append(n * (not out))
                        if len(have[0]) > 8:
                            grams[c] = [[x] for x in _summed(*have)]
                        for t in texts:
                            if out:
                                for w in set(t.lower().split()):
                                    count.setdefault(w, 0)
                            else:
                                count.update(t.lower().split())
                        count[END] += 0 if out else len(texts)
                if sum(len(x) for g, _ in grams.values() for x in g) > HELD_GRAMS or sum(map(len, words.values())) > HELD_WORDS:
                    for c, have in grams.items():
                        grams[c] = [[x] for x in _summed(*have)]
                    if sum(len(g[0]) for g, _ in grams.values()) > HELD_GRAMS // 2 or sum(map(len, words.values())) > HELD_WORDS:
                        yield from told()
        yield from told()

    return docs.select("chunk", "text", "held_out").mapInArrow(run, schema)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series eight steps further up."""
    y = x + 8.0
    s = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    prod = np.ones_like(y)
    for i in range(8):
        prod *= x + i
    return s - np.log(prod)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


_SMALL = 64
_TABLE = log_kt(*np.meshgrid(np.arange(_SMALL, dtype=float), np.arange(_SMALL, dtype=float), indexing="ij"))


def fast_log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """``log_kt`` with small counts from a table."""
    out = _TABLE[np.minimum(n0, _SMALL - 1).astype(np.int32), np.minimum(n1, _SMALL - 1).astype(np.int32)]
    large = np.flatnonzero((n0 >= _SMALL) | (n1 >= _SMALL))
    out[large] = log_kt(n0[large], n1[large])
    return out


class Level:
    """The nodes of one depth: sorted ids, estimate of a one, and weight of stopping here."""

    def __init__(self, ids, n0, n1, children=None):
        self.ids, self.n0, self.n1 = ids, n0, n1
        kt = log_kt(n0, n1)
        self.p1 = (n1 + 0.5) / (n0 + n1 + 1.0)
        if children is None:
            self.log_pw, self.stop = kt, np.ones(len(ids))
        else:
            self.log_pw = np.log(0.5) + np.logaddexp(kt, children)
            self.stop = np.exp(np.log(0.5) + kt - self.log_pw)

    def find(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.ids, nodes), max(0, len(self.ids) - 1))
        return at, (self.ids[at] == nodes) if len(self.ids) else np.zeros(len(nodes), bool)


def low_levels(ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> list[Level]:
    """Depths 0 and 1 from the sums of depth 1; an id is the context byte and the bits so far with a leading 1."""
    one = Level(ids, n0, n1, below)
    roots, inv = np.unique(ids & np.uint64(255), return_inverse=True)
    return [Level(roots, *(np.bincount(inv, x, len(roots)) for x in (n0, n1, one.log_pw))), one]


class Depth:
    """The nodes of one depth of a block of grams: per bit the run of each entry, and each run's estimate, weight and log-probability."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, child: Depth | None, up: np.ndarray | None):
        self.keys, self.run, self.first, self.p1, self.stop, self.seen, self.log_pw, self.counts = keys, [], [], [], [], [], [], []
        for j in range(8):
            node = keys >> np.uint64(8 - j)
            fresh = np.ones(len(keys), bool)
            np.not_equal(node[1:], node[:-1], out=fresh[1:])
            first, run = np.flatnonzero(fresh), np.cumsum(fresh, dtype=np.int32) - np.int32(1)
            total = np.add.reduceat(n, first)
            n1 = np.add.reduceat(n * ((keys >> np.uint64(7 - j)) & ONE), first)
            kt = log_pw = fast_log_kt(total - n1, n1)
            stop = np.ones(len(first), np.float32)
            if child is not None:
                below = np.bincount(run[up[child.first[j]]], child.log_pw[j], len(first))
                log_pw = np.log(0.5) + np.logaddexp(kt, below)
                stop = np.exp(np.log(0.5) + kt - log_pw).astype(np.float32)
            for held, x in ((self.run, run), (self.first, first), (self.p1, ((n1 + 0.5) / (total + 1.0)).astype(np.float32)), (self.stop, stop), (self.seen, total > 0), (self.log_pw, log_pw), (self.counts, (total - n1, n1))):
                held.append(x)


class Tree:
    """Depths ``lowest`` to ``DEPTH`` of whole groups of that many context bytes: sorted distinct grams with their training counts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, lowest: int = 2):
        self.lowest, self.depths, self.up = lowest, {}, {}
        keys, child, up = grams, None, None
        n = n.astype(float)
        for d in range(DEPTH, lowest - 1, -1):
            if d < DEPTH:
                keys, up = np.unique(((keys >> np.uint64(16)) << EIGHT) | (keys & np.uint64(255)), return_inverse=True)
                n = np.bincount(up, n, len(keys))
                self.up[d + 1] = up
            child = self.depths[d] = Depth(keys, n, child, up)

    def nodes(self) -> tuple[np.ndarray, ...]:
        """The nodes of the lowest depth that training has seen: ids (context and bits so far with a leading 1), zeros, ones, log-probabilities."""
        low, parts = self.depths[self.lowest], []
        for j in range(8):
            keys, seen = low.keys[low.first[j]], low.seen[j]
            ids = ((keys >> EIGHT) << EIGHT) | np.uint64(1 << j) | ((keys & np.uint64(255)) >> np.uint64(8 - j))
            parts.append([x[seen] for x in (ids, *low.counts[j], low.log_pw[j])])
        return tuple(map(np.concatenate, zip(*parts)))

    def log10(self, low: list[Level]) -> np.ndarray:
        """log10 of the mixed probability of each gram's byte after its context; ``low`` are the depths above the lowest.

        From the root down: what the nodes so far give (``have``), the weight left for deeper ones (``left``),
        and the estimate if the last node is the deepest that training has seen (``now``).
        """
        keys = self.depths[self.lowest].keys
        shape = len(keys), 8
        now, have, left = np.full(shape, 0.5, np.float32), np.zeros(shape, np.float32), np.ones(shape, np.float32)
        for d, level in enumerate(low):
            context = (keys >> np.uint64(8 * (self.lowest - d) + 8)) << EIGHT if d else np.uint64(0)
            for j in range(8):
                at, hit = level.find(context | np.uint64(1 << j) | ((keys & np.uint64(255)) >> np.uint64(8 - j)))
                if len(level.ids):
                    p, w = level.p1[at].astype(np.float32), level.stop[at].astype(np.float32)
                    now[:, j] = np.where(hit, have[:, j] + left[:, j] * p, now[:, j])
                    have[:, j] += np.where(hit, left[:, j] * w * p, 0)
                    left[:, j] *= np.where(hit, 1 - w, 1)
        for d in range(self.lowest, DEPTH + 1):
            depth, up = self.depths[d], self.up.get(d)
            out = np.empty(len(depth.keys)) if d == DEPTH else None
            kept = [] if d < DEPTH else None
            for at in range(0, len(depth.keys), 100_000):
                rows = slice(at, at + 100_000)
                parent = np.arange(len(depth.keys))[rows] if up is None else up[rows]
                a, b, c = now[parent], have[parent], left[parent]
                for j in range(8):
                    run = depth.run[j][rows]
                    p, w = depth.p1[j][run], depth.stop[j][run]
                    a[:, j] = np.where(depth.seen[j][run], b[:, j] + c[:, j] * p, a[:, j])
                    if kept is not None:
                        b[:, j] += c[:, j] * w * p
                        c[:, j] *= 1 - w
                if kept is not None:
                    kept.append((a, b, c))
                else:
                    bits = (depth.keys[rows, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & ONE
                    out[rows] = np.log10(np.where(bits == 1, a, 1 - a).astype(float)).sum(axis=1)
            if kept is not None:
                now, have, left = map(np.concatenate, zip(*kept))
        return out


def _split(grams: np.ndarray, lowest: int) -> list[slice]:
    """Blocks of about ``GROUPED_ROWS`` grams, of whole groups of ``lowest`` context bytes each."""
    group = grams >> np.uint64(8 * (DEPTH - lowest) + 8)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(grams))
    out, start = [], 0
    while start < len(grams):
        end = int(ends[max(np.searchsorted(ends, start + GROUPED_ROWS, side="right") - 1, np.searchsorted(ends, start, side="right"))])
        out.append(slice(start, end))
        start = end
    return out


def nodes_of(grams: np.ndarray, n: np.ndarray, lowest: int = 2) -> tuple[np.ndarray, ...]:
    """``Tree.nodes`` of depth ``lowest``; a group that is too large for one tree is put together from deeper ones."""
    if len(grams) <= 2 * GROUPED_ROWS or lowest == DEPTH:
        return Tree(grams, n, lowest).nodes()
    level = level_above([nodes_of(grams[b], n[b], lowest + 1) for b in _split(grams, lowest + 1)])
    return level.ids, level.n0, level.n1, level.log_pw


def level_above(parts: list[tuple[np.ndarray, ...]]) -> Level:
    """The nodes one byte further up from those of a depth."""
    ids, n0, n1, log_pw = map(np.concatenate, zip(*parts))
    u, inv = np.unique(((ids >> np.uint64(16)) << EIGHT) | (ids & np.uint64(255)), return_inverse=True)
    return Level(u, *(np.bincount(inv, x, len(u)) for x in (n0, n1, log_pw)))


def log10_of(grams: np.ndarray, n: np.ndarray, low: list[Level], lowest: int = 2) -> np.ndarray:
    """``Tree.log10``; a group that is too large for one tree is computed by its next bytes."""
    if len(grams) <= 2 * GROUPED_ROWS or lowest == DEPTH:
        return Tree(grams, n, lowest).log10(low)
    blocks = _split(grams, lowest + 1)
    low = [*low, level_above([nodes_of(grams[b], n[b], lowest + 1) for b in blocks])]
    return np.concatenate([log10_of(grams[b], n[b], low, lowest + 1) for b in blocks])


def _in_groups(grams: DataFrame, compute, schema: T.StructType) -> DataFrame:
    """Run ``compute(grams, counts, rows)`` over blocks of whole groups; rows are (chunk, pair, packed grams, packed counts).

    Rows wait packed (one or two bytes a gram); their grams are merged a few rows at a time.
    """
    dealt = grams.repartition("pair").sortWithinPartitions("pair").select("chunk", "pair", "k", "counts")

    def merged(rows):
        g, n, held = [], [], 0
        for r in rows:
            g.append(restored_grams(r[2]))
            n.append(restored(r[3], np.uint32).astype(np.int64))
            held += len(g[-1])
            if held > 2 * len(g[0]) + 4 * GROUPED_ROWS:
                g, n = ([x] for x in _summed(g, n))
                held = len(g[0])
        return _summed(g, n)

    def run(batches):
        rows, waiting = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = tuple(batch.column(c)[i].as_py() for c in range(4))
                if waiting >= GROUPED_ROWS and row[1] != rows[-1][1]:
                    yield from compute(*merged(rows), rows)
                    rows, waiting = [], 0
                rows.append(row)
                waiting += len(row[2])  # about a byte a gram
        if rows:
            yield from compute(*merged(rows), rows)

    return dealt.mapInArrow(run, schema)


def _low(grams: DataFrame) -> list[Level]:
    """Depths 0 and 1 of the corpus; at most 65,280 rows reach the driver."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("n0", T.DoubleType()), T.StructField("n1", T.DoubleType()), T.StructField("below", T.DoubleType())])

    def compute(g, n, rows):
        ids, n0, n1, log_pw = nodes_of(g, n)
        up, inv = np.unique(((ids >> np.uint64(16)) << EIGHT) | (ids & np.uint64(255)), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(up.astype(np.int64)), *(pa.array(np.bincount(inv, x, len(up))) for x in (n0, n1, log_pw))], names=schema.names)

    rows = _in_groups(grams, compute, schema).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).collect()
    rows.sort(key=lambda r: r.node)
    return low_levels(*(np.array([r[c] for r in rows], np.uint64 if c == "node" else float) for c in ("node", "n0", "n1", "below")))


def ctw_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    spark = df.sparkSession
    small_batches(spark)
    docs = with_chunks(df, id_col, text_col)
    keys = write_table(gathered(docs))
    chunks = max(1, keys.select("chunk").distinct().count())
    grams, words = keys.filter("pair >= 0"), keys.filter("pair < 0")
    counts = write_table(words.groupBy("k").agg(F.sum("n").alias("v")))
    total, distinct = counts.filter("v > 0").agg(F.coalesce(F.sum("v"), F.lit(0)), F.count("*")).first()
    low = spark.sparkContext.broadcast(_low(grams))

    packed = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("k", T.BinaryType()), T.StructField("v", T.BinaryType())])

    def logs(g, n, rows):
        values = log10_of(g, n, low.value).astype(np.float32)
        for at in range(0, len(rows), 500):
            some = rows[at : at + 500]
            each = [squeezed(values[np.searchsorted(g, restored_grams(r[2]))]) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.binary()), pa.array(each, pa.binary())], names=packed.names)

    id_type = docs.schema["id"].dataType
    none = lambda t: F.lit(None).cast(t)
    rest = [none(id_type).alias("id"), none("string").alias("text"), none("boolean").alias("held_out")]
    told = words.select("chunk", "k").join(counts, "k").select("chunk", F.lit(0).alias("tag"), "k", F.col("v").alias("n"), none("binary").alias("v"), *rest)
    known = _in_groups(grams, logs, packed).select("chunk", F.lit(1), "k", none("long"), "v", *rest)
    rows = told.union(known).union(docs.select("chunk", F.lit(2), none("binary"), none("long"), none("binary"), "id", "text", "held_out"))
    names = [(id_col, id_type), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType())]
    schema = T.StructType([T.StructField(*x) for x in names])

    def run(batches):
        import pandas as pd

        now, part_g, part_v, words, index, table = None, [], [], {}, None, None
        floor = np.log10(total + 0.1 * (distinct + 1))
        unknown = np.log10(0.5)  # between a count of 0 and one of 1
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            tags = batch.column(1).to_numpy()
            edges = np.flatnonzero((chunks[1:] != chunks[:-1]) | (tags[1:] != tags[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(chunks)]):
                if hi == lo:
                    continue
                if chunks[lo] != now:
                    now, part_g, part_v, words, index, table = chunks[lo], [], [], {}, None, None
                piece = batch.slice(lo, hi - lo)
                if tags[lo] == 0:
                    words.update(zip(piece.column(2).to_pylist(), np.log10(piece.column(3).to_numpy() + 0.1).tolist()))
                    continue
                if tags[lo] == 1:
                    part_g += [restored_grams(k) for k in piece.column(2).to_pylist()]
                    part_v += [restored(v, np.float32) for v in piece.column(4).to_pylist()]
                    continue
                if index is None:  # a gram comes more than once where several tasks, or one in several goes, gathered from the chunk
                    grams_, first = np.unique(np.concatenate(part_g), return_index=True)
                    index, table = pd.Index(grams_), np.concatenate(part_v)[first]
                    part_g, part_v = [], []
                for some in sized_slices(piece, 6, 2 << 20):
                    texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in some.column(6).to_pylist()]
                    g, ends = pack(texts)
                    at = index.get_indexer(g)
                    assert (at >= 0).all(), "a chunk met a text that it was not gathered from"
                    score = np.add.reduceat(table[at].astype(float), np.concatenate([[0], ends[:-1]]))
                    n, known_n, base = [], [], []
                    for t in texts:
                        tokens = t.lower().split()
                        tokens.append(END)
                        logs = np.fromiter(map(words.__getitem__, tokens), float, len(tokens))
                        n.append(len(logs))
                        known_n.append(int((logs > unknown).sum()))
                        base.append(float((logs - floor).sum()))
                    size = np.array([len(t) + 1 for t in texts])
                    yield pa.RecordBatch.from_arrays([some.column(5), some.column(7), pa.array(n, pa.int64()), pa.array(known_n, pa.int64()), pa.array([total] * len(n), pa.int64()), pa.array(base), pa.array(score), pa.array(-score / np.log10(2) / size)], names=schema.names)

    return rows.repartition(2 * chunks, "chunk").sortWithinPartitions("chunk", "tag").mapInArrow(run, schema)
