"""Near-duplicate groups by MinHash with sequential Bayesian verification.

Plan: every text becomes its set of hashed word shingles, a digest of that set and a MinHash
signature. Texts with equal sets are one class, represented by its smallest id. Signatures are
cut into bands; representatives that share a band are candidates.

Candidates are never expanded to all pairs of a band. First each member meets the smallest
representative of its band; signatures are compared batch by batch and a pair is dropped as
soon as the posterior probability of a similarity at or above the threshold falls under the
chosen miss probability; the rest is verified on full shingle sets. The components of these links
settle nearly everything. What is left are bands that still hold several components. Their
members are compared in blocks of bounded size with the same sequential test, each pair in the
first band that it shares; texts that have a surviving pair across components meet once more in
their block, where full sets decide, and only links that join components leave the task. Every
pair that shares a band is thus linked, tested, or already in one component, and no table holds
the pairs of a group.

Shingles are compared as 64-bit hashes. A pair at the threshold shares none of the 32 bands of 4
values with probability 5e-8.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; a text
shorter than a shingle counts as one shingle; repeated rows are copies; rows with a null id take
part through their class and stay only if no row with an id has the same set; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import bounded, map_texts, spread_join, write_shared, write_table

BANDS, ROWS = 32, 4
BATCH = 32  # signature values compared at a time
MISS = 1e-6  # posterior probability under which a pair is dropped
BLOCK = 256  # members of a band that are compared with each other at a time
SPLIT_EDGES = 2_000  # links beyond which the neighbours of one text are split among tasks
WORDS_KEPT = 200_000  # word hashes that a task keeps between texts

_rng = np.random.default_rng(20240229)
MULT = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of a text; word hashes are kept between texts."""

    def __init__(self, words: int):
        self.words, self.kept = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII letters and blanks only
        if not tokens:
            return np.empty(0, np.uint64)
        kept = self.kept
        if len(kept) > WORDS_KEPT:
            kept.clear()
        for t in set(tokens).difference(kept):
            kept[t] = xxhash.xxh3_64_intdigest(t)
        w = np.fromiter(map(kept.__getitem__, tokens), np.uint64, len(tokens))
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
        return np.unique(h)


def signature(shingles: np.ndarray) -> bytes:
    """32-bit minima of the shingles under each hash function, as little-endian bytes."""
    low = np.full(len(MULT), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 512):
        x = shingles[at : at + 512, None]
        low = np.minimum(low, ((x * MULT + ADD) >> np.uint64(32)).min(axis=0))
    return low.astype("<u4").tobytes()


def min_matches(threshold: float, batches: int = BANDS * ROWS // BATCH) -> list[int]:
    """Per number of compared batches the fewest equal values with which a pair goes on.

    With a uniform prior, after m equal values of n the posterior probability of a similarity
    of at least t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in (BATCH * (i + 1) for i in range(batches)):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < MISS:
            m += 1
        out.append(m)
    return out


def sequential(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices of the rows of two signature matrices that pass every batch."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, m in enumerate(least):
        cols = slice(i * BATCH, (i + 1) * BATCH)
        equal = equal + (a[alive, cols] == b[alive, cols]).sum(axis=1)
        go = equal >= m
        alive, equal = alive[go], equal[go]
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, BANDS * ROWS)


def shingle_sets(df: DataFrame, words: int, signatures: bool, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_shingles, digest of the set (null if empty) and, on demand, the signature."""

    def make():
        shingles = Shingler(words)

        def sets(texts):
            each = [shingles(t) for t in texts]
            out = [[len(s) for s in each], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in each]]
            return [*out, [signature(s) if len(s) else None for s in each]] if signatures else out

        return sets

    columns = [("n_shingles", T.LongType()), ("digest", T.BinaryType())] + [("sig", T.BinaryType())] * signatures
    return map_texts(df, make, columns, id_col, text_col)


def _bayes_pairs(pairs: DataFrame, classes: DataFrame, least: list[int]) -> DataFrame:
    """The pairs (a, b) whose signatures pass the sequential test."""
    sig = classes
    both = spread_join(pairs, sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    schema = T.StructType([both.schema["a"], both.schema["b"]])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = sequential(_matrix(batch.column(2)), _matrix(batch.column(3)), least)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])

    return both.mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full shingle sets."""
    ids = _packed(write_shared(pairs.select(F.explode(F.array("a", "b")).alias(id_col)).distinct()))
    need = texts.select(id_col, F.col(text_col).cast("string").alias("_t")).join(bounded(ids), id_col, "left_semi")
    # a class has one set, but rows may share an id: the texts of an id are tried one by one
    both = spread_join(pairs, need.toDF("a", "_ta"), "a").join(need.toDF("b", "_tb"), "b").select("a", "b", "_ta", "_tb")
    schema = T.StructType([both.schema["a"], both.schema["b"]])

    def run(batches):
        shingles, last, held = Shingler(words), None, None
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):  # one pair of texts decoded at a time
                ta = batch.column(2)[i].as_py()
                if ta != last:
                    last, held = ta, shingles(ta)
                other = shingles(batch.column(3)[i].as_py())
                both_have = len(np.intersect1d(held, other, assume_unique=True))
                if both_have and 100 * both_have >= percent * (len(held) + len(other) - both_have):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=["a", "b"])

    return both.mapInArrow(run, schema)


def _blocks(batches):
    """Tables of whole (key, i, j) blocks from rows sorted by them, with the offsets of the blocks."""

    def cuts(table):
        block = np.stack([table[c].to_numpy() for c in ("key", "i", "j")])
        return np.flatnonzero((block[:, 1:] != block[:, :-1]).any(axis=0)) + 1

    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, 2 * BLOCK):
            part = pa.Table.from_batches([batch.slice(at, 2 * BLOCK)])
            held = part if held is None else pa.concat_tables([held, part])
            at_ = cuts(held)
            if len(at_) and held.num_rows >= 2 * BLOCK:
                yield held.slice(0, at_[-1]).combine_chunks(), [0, *at_.tolist()]
                held = held.slice(at_[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), [0, *cuts(held).tolist(), held.num_rows]


def _column(table: pa.Table, name: str) -> pa.Array:
    col = table[name].combine_chunks()
    return col.chunk(0) if isinstance(col, pa.ChunkedArray) else col


def _across(comp: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which pairs of a block's members are compared: of different components, and from its two sides if it has two."""
    two = side.min() != side.max()
    go = (side[:, None] < side[None, :]) if two else np.triu(np.ones((len(side), len(side)), bool), 1)
    return go & (comp[:, None] != comp[None, :])


def _suspects(dealt: DataFrame, least: list[int]) -> DataFrame:
    """Members of each block that have a pair across components which passes the sequential test.

    A pair counts in the first band that it shares, so later bands need not see its texts.
    """
    schema = T.StructType([dealt.schema[c] for c in ("key", "i", "j", "side", "rep", "comp")])

    def run(batches):
        for table, at in _blocks(batches):
            sig, side, band = _matrix(_column(table, "sig")), table["side"].to_numpy(), table["band"].to_numpy()
            comp = _column(table, "comp").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            found = np.zeros(len(side), bool)
            for lo, hi in zip(at[:-1], at[1:]):
                x, y = np.nonzero(_across(comp[lo:hi], side[lo:hi]))
                for k in range(0, len(x), 50_000):
                    p, q = x[k : k + 50_000] + lo, y[k : k + 50_000] + lo
                    keep = sequential(sig[p], sig[q], least)
                    p, q = p[keep], q[keep]
                    first = (sig[p] == sig[q]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[lo]
                    found[p[first]] = found[q[first]] = True
            yield table.select(schema.names).take(pa.array(np.flatnonzero(found))).combine_chunks().to_batches() if found.any() else []

    def flat(batches):
        for some in run(batches):
            yield from some

    return dealt.mapInArrow(flat, schema)


def _block_links(suspects: DataFrame, texts: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links across components inside blocks, on full shingle sets; per block only those that join components."""
    ids = _packed(write_shared(suspects.select(F.col("rep").alias(id_col)).distinct()))
    need = texts.select(id_col, F.col(text_col).cast("string").alias("_t")).join(bounded(ids), id_col, "left_semi")
    whole = suspects.join(need.withColumnRenamed(id_col, "rep"), "rep").select("key", "i", "j", "side", "rep", "comp", "_t")
    schema = T.StructType([T.StructField("a", suspects.schema["rep"].dataType), T.StructField("b", suspects.schema["rep"].dataType)])

    def common(sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of all pairwise intersections, from the shingles that two members share at least."""
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.cumsum(times > 1) - 1
        keep = times[of] > 1
        owner, of = owner[keep], rank[of[keep]]
        out = np.zeros((len(sets), len(sets)))
        for at in range(0, int(of.max()) + 1 if len(of) else 0, 8192):
            mine = (of >= at) & (of < at + 8192)
            m = np.zeros((len(sets), 8192), np.float32)
            m[owner[mine], of[mine] - at] = 1
            out += m @ m.T
        return out

    def run(batches):
        shingles = Shingler(words)
        for table, at in _blocks(batches):
            rep, side = _column(table, "rep"), table["side"].to_numpy()
            comp = _column(table, "comp").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            a, b = [], []
            for lo, hi in zip(at[:-1], at[1:]):
                sets = [shingles(t) for t in table["_t"].slice(lo, hi - lo).to_pylist()]
                size, both = np.array([len(s) for s in sets]), common(sets)
                near = (both > 0) & (100 * both >= percent * (size[:, None] + size[None, :] - both))
                root = {}

                def find(c):
                    while root.get(c, c) != c:
                        c = root[c]
                    return c

                for x, y in zip(*np.nonzero(near & _across(comp[lo:hi], side[lo:hi]))):
                    p, q = find(comp[lo + x]), find(comp[lo + y])
                    if p != q:
                        root[p] = q
                        a.append(lo + x)
                        b.append(lo + y)
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(a, pa.int64())), rep.take(pa.array(b, pa.int64()))], names=["a", "b"])

    return whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def _packed(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A checkpointed table in as few partitions as its rows need, so that small tables make few files."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); root is the smallest node reachable.

    Alternating stars: neighbours above a node are tied to its smallest neighbour, then those
    below it, until every node hangs on a root directly. Rounds grow with the logarithm of the
    longest path; each is checkpointed.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    many = now.count() > SPLIT_EDGES
    for _ in range(most):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        join = spread_join if many else DataFrame.join  # the centre of a star may have any number of neighbours
        large = join(both, low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = join(large, low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v")))
        now = _packed(write_shared(small.filter("u <> v").distinct()))
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(now.select("v", F.lit(0)))
        loose = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("root")).filter((F.col("ups") > 1) | (F.col("ups") == 1) & (F.col("root") == 0))
        if loose.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {most} rounds")


def near_duplicates(
    df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id (smallest id reachable over links) and kept (id is component_id)."""
    least = min_matches(percent / 100)
    sets = write_table(shingle_sets(df, words, True, id_col, text_col))  # every text is shingled here, and later only members of verified pairs
    classes = write_shared(sets.filter("digest is not null").groupBy("digest").agg(F.min(id_col).alias("rep"), F.first("sig").alias("sig")).filter("rep is not null"))

    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)])
    bands = classes.select("rep", F.posexplode(keys).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n")).filter("low < high")
    members = _packed(write_shared(bands.join(shared.select("key", "low", "n"), "key").select("key", "band", "rep", "low", "n")))
    # only representatives that share a band take their signatures along from here
    busy = _packed(write_shared(classes.join(bounded(members.select("rep").distinct()), "rep", "left_semi").select("rep", "sig")), 20_000)

    stars = members.filter("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    survivors = _packed(write_shared(_bayes_pairs(_packed(write_shared(stars)), busy, least)))
    links = _packed(write_shared(_verified(survivors, df, words, percent, id_col, text_col)))
    roots = components(links)

    known = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", "n", F.coalesce("root", "rep").alias("comp"))
    mixed = known.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("key")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        known.join(mixed, "key").join(busy, "rep")
        .withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "band", "rep", "comp", "sig")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    )
    suspects = _packed(write_shared(_suspects(dealt, least)))
    more = write_shared(_block_links(suspects, df, words, percent, id_col, text_col))
    if not more.isEmpty():
        roots = components(reduce(DataFrame.union, [more.select("a", "b"), roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]))

    final = classes.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").groupBy("digest").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    rows = spread_join(sets.select(id_col, "n_shingles", "digest"), final, "digest", "left")
    comp = F.when(F.col("digest").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return rows.select(id_col, "n_shingles", comp.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))
