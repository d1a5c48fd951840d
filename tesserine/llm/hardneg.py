"""Hard negatives by slot-decomposed selection.

An anchor's positives are the rows of its label with the highest scores. Each gives a window of
negative scores, from ``LOW`` to ``HIGH`` per cent of its own. The upper ends of an anchor's windows cut
the scores into disjoint slots; whoever meets a negative keeps it for one slot, and a slot keeps
its first ``NEGATIVES`` rows. Whatever lies at or under an upper end is in the slots from its own
downwards, so one pass over the slots from the lowest up, each put before what it carries and
cut to length, answers every window however they overlap; rows under a window's lower end then fall off.

Plan: rows are packed into blocks of whole-number vectors once. Blocks of anchors meet blocks of
rows by one shuffle; a task multiplies them and keeps per anchor the first positives, and in the
second pass the first negatives per slot, over all the row blocks it meets. A window with a rank
limit merges what tasks kept. Nothing passes the driver but counts.

Scores are exact: products in floating point while they stay below 2^49, whole numbers of any
length beyond; scores beyond 64 bits are given as the nearest of 64 bits.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take
no part; of rows that share an id one takes part, the smallest by label and vector; ties go to
the smaller id; vectors of unequal length are filled with zeros; components beyond 2^62 after
scaling count as 2^62; an anchor without positives, or a window without rows, gives no rows; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .textops import write_table

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of a positive's score
SCALE = 256
BLOCK = 4096  # rows of a block
GROUP = 32  # row blocks that meet a block of anchors in one task
ANCHORS = 8192  # anchors of a block
TILE = 512  # anchors that are multiplied at a time
NONE = -(1 << 62)
EXACT = 1 << 49

BLOCKS = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("ids", "labels", "limits")), T.StructField("dim", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType())])


def participants(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, vector) of the rows that take part, one per id."""
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & good)
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")


def whole_numbers(vectors: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, as 64-bit whole numbers, in rows of the greatest length."""
    size = max(map(len, vectors), default=0)
    flat = np.zeros((len(vectors), size))
    for row, v in zip(flat, vectors):
        row[: len(v)] = v
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -(2.0**62), 2.0**62).astype(np.int64)


def _pack(block: int, ids: np.ndarray, labels: np.ndarray, limits: np.ndarray, data: np.ndarray) -> list:
    most = int(np.abs(data).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return [block, ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), limits.astype("<i8").tobytes(), data.shape[1], kind, data.astype(kind).tobytes()]


class Block:
    """A packed block: ids, labels, limits (rows of windows' ends) and vectors."""

    def __init__(self, table: pa.Table, i: int):
        get = lambda c: table[c][i].as_py()
        self.ids, self.labels = np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("labels"), "<i8")
        self.limits = np.frombuffer(get("limits"), "<i8").reshape(len(self.ids), -1)
        self.data = np.frombuffer(get("data"), get("kind")).reshape(len(self.ids), -1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors."""
    size = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, size - x.shape[1]))) if x.shape[1] < size else x for x in (a, b))
    most = lambda x: int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    if size * most(a) * most(b) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def first(s: np.ndarray, go: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``s`` its ``k`` highest entries where ``go`` holds, ties to the smaller id; ``NONE`` where there are fewer.

    ``ids`` ascend. The order within a row is not fixed.
    """
    n = s.shape[1]
    if s.dtype == object:
        out = np.full((len(s), k), NONE, object), np.zeros((len(s), k), np.int64)
        for r in range(len(s)):
            best = sorted(np.flatnonzero(go[r]).tolist(), key=lambda c: (-s[r, c], c))[:k]
            out[0][r, : len(best)], out[1][r, : len(best)] = s[r, best], ids[best]
        return out
    key = np.where(go, s * n + np.arange(n - 1, -1, -1), NONE)
    at = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), key.shape)
    taken = np.take_along_axis(key, at, 1)
    return np.where(taken == NONE, NONE, np.take_along_axis(s, at, 1)), ids[at]


def merged(best: tuple | None, more: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` per row of two selections, in order."""
    s, i = more if best is None else (np.concatenate(x, axis=1) for x in zip(best, more))
    order = np.lexsort((i, -s), axis=1)[:, :k] if s.dtype != object else np.array([sorted(range(s.shape[1]), key=lambda c: (-s[r, c], i[r, c]))[:k] for r in range(len(s))])
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _sorted_block(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(block.ids, kind="stable")
    return block.ids[order], block.labels[order], block.data[order]


def row_blocks(rows: DataFrame, scale: int) -> DataFrame:
    """Blocks of the rows as they lie in their partitions."""
    arrow = to_arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = part.column(0).to_numpy()
                made = _pack(int(ids[0]) & 0x7FFFFFFF, ids, part.column(1).to_numpy(), np.empty((len(ids), 0)), whole_numbers(part.column(2).to_pylist(), scale))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, arrow)], schema=arrow)

    return rows.select("id", "label", "vector").mapInArrow(run, BLOCKS)


def anchor_blocks(anchors: DataFrame, total: int, scale: int) -> DataFrame:
    """Blocks of the anchors (id, label, vector, limits), dealt by their ids."""
    arrow = to_arrow_schema(BLOCKS)

    def run(table: pa.Table) -> pa.Table:
        limits = table["limits"].to_pylist()
        wide = np.full((len(limits), max(map(len, limits), default=0)), NONE)
        for row, x in zip(wide, limits):
            row[: len(x)] = x
        made = _pack(table["block"][0].as_py(), table["id"].to_numpy(), table["label"].to_numpy(), wide, whole_numbers(table["vector"].to_pylist(), scale))
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(made, arrow)], schema=arrow)

    block = F.pmod(F.xxhash64("id"), F.lit(total)).alias("block")
    return anchors.select(block, "id", "label", "vector", "limits").groupBy("block").applyInArrow(run, BLOCKS)


def meet(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, slots: int, k: int) -> DataFrame:
    """(anchor_id, slot, score, id): what each task keeps of the blocks that meet in it.

    ``slots`` 0: the ``k`` first rows of the anchor's label. Else the ``k`` first rows of other labels per slot of
    the anchor's limits, which are the least score and then the upper ends, descending.
    """
    grid = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = anchors.withColumn("group", grid(groups)).withColumn("row", F.lit(0))
    right = rows.withColumn("group", F.pmod(F.xxhash64("block", "ids"), F.lit(groups))).withColumn("block", grid(blocks)).withColumn("row", F.lit(1))
    both = left.unionByName(right).repartition(blocks * groups, "block", "group").sortWithinPartitions("block", "group", "row")
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor_id", "slot", "score", "id")])
    arrow = to_arrow_schema(out)

    def select(mine: Block, best: dict, other: Block) -> None:
        ids, labels, data = _sorted_block(other)
        for at in range(0, len(mine.ids), TILE):
            part = slice(at, at + TILE)
            s = scores(mine.data[part], data)
            same = mine.labels[part, None] == labels[None, :]
            if not slots:
                best[at, 0] = merged(best.get((at, 0)), first(s, same & (mine.ids[part, None] != ids[None, :]), ids, k), k)
                continue
            limits = mine.limits[part]
            go = ~same & (s >= limits[:, :1]) & (s <= limits[:, 1:2])
            for j in range(limits.shape[1] - 1):
                here = go & (s > limits[:, j + 2, None]) if j + 2 < limits.shape[1] else go
                if here.any():
                    best[at, j] = merged(best.get((at, j)), first(s, here, ids, k), k)
                go &= ~here

    def told(mine: Block, best: dict) -> Iterator[pa.RecordBatch]:
        for (at, j), (s, i) in best.items():
            x, y = np.nonzero(s > NONE)
            if len(x):
                score = np.array([max(-(1 << 63), min((1 << 63) - 1, v)) for v in s[x, y]], np.int64) if s.dtype == object else s[x, y]
                yield pa.RecordBatch.from_arrays([pa.array(mine.ids[at + x]), pa.array(np.full(len(x), j)), pa.array(score), pa.array(i[x, y])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, best = None, {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i, row in enumerate(table["row"].to_pylist()):
                if row:
                    if mine is not None and mine.at == (table["block"][i].as_py(), table["group"][i].as_py()):  # a block may have no anchors
                        select(mine, best, Block(table, i))
                    continue
                if mine is not None:
                    yield from told(mine, best)
                mine, best = Block(table, i), {}
                mine.at = (table["block"][i].as_py(), table["group"][i].as_py())
        if mine is not None:
            yield from told(mine, best)

    return both.mapInArrow(run, out)


def _ranked(kept: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _ends(score: int, low: int, high: int) -> tuple[int, int]:
    """The window of a positive's score: whole numbers n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def limits(found: list[int], low: int, high: int) -> list[int]:
    """Least score of all windows, then their distinct upper ends, descending; empty without windows."""
    windows = [(a, b) for a, b in (_ends(s, low, high) for s in found) if a <= b]
    return [min(a for a, _ in windows), *sorted({b for _, b in windows}, reverse=True)] if windows else []


def answers(found: list[tuple[int, int]], slots: dict[int, list[tuple[int, int]]], low: int, high: int, k: int) -> list[tuple]:
    """(positive_id, rank, negative_id, positive_score, negative_score) of one anchor.

    ``found``: positives (score, id). ``slots``: rows (score, id) by slot, in order; slot 0 has the highest scores.
    """
    ends = limits([s for s, _ in found], low, high)[1:]
    suffix, carried = {}, []
    for j in range(len(ends) - 1, -1, -1):
        carried = (slots.get(j, []) + carried)[:k]  # every score of a slot is above those of the next
        suffix[ends[j]] = carried
    out = []
    for score, of in found:
        least, most = _ends(score, low, high)
        window = [n for n in suffix[most] if n[0] >= least] if least <= most else []
        out += [(of, r, i, score, s) for r, (s, i) in enumerate(window, 1)]
    return out


def hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id``.
    """
    rows = write_table(participants(df, id_col, label_col, vector_col))
    anchors = rows.filter(is_anchor)
    n, m = rows.count(), anchors.count()
    blocks = max(1, -(-m // ANCHORS))
    tasks = -(-2 * rows.sparkSession.sparkContext.defaultParallelism // blocks)  # small tables still use all cores
    groups = max(1, -(-n // (GROUP * BLOCK)), min(tasks, -(-n // 1024)))
    packed = write_table(row_blocks(rows, scale))

    bare = anchor_blocks(anchors.withColumn("limits", F.array().cast("array<long>")), blocks, scale)
    found = write_table(_ranked(meet(bare, packed, blocks, groups, 0, positives), positives))
    arrow = to_arrow_schema(T.StructType([T.StructField("id", T.LongType()), T.StructField("limits", T.ArrayType(T.LongType()))]))

    def ends(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([limits(s, low, high) for s in batch.column(1).to_pylist()], pa.list_(pa.int64()))], schema=arrow)

    windows = found.groupBy("anchor_id").agg(F.collect_list("score").alias("s")).mapInArrow(ends, "id long, limits array<long>").filter(F.size("limits") > 0)
    armed = anchor_blocks(anchors.join(windows, "id"), blocks, scale)
    kept = _ranked(meet(armed, packed, blocks, groups, positives, negatives), negatives)

    out = T.StructType([T.StructField(c, T.IntegerType() if c == "rank" else T.LongType()) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])
    schema = to_arrow_schema(out)

    def windows_of(table: pa.Table) -> pa.Table:
        some = sorted(zip(*(table[c].to_pylist() for c in ("slot", "rank", "score", "id"))))
        slots: dict[int, list] = {}
        for slot, _, score, of in some:
            slots.setdefault(slot, []).append((score, of))
        made = answers(slots.pop(-1, []), slots, low, high, negatives)
        anchor = table["anchor_id"][0].as_py()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(anchor, *r) for r in made]) if made else [[]] * 6, schema)], schema=schema)

    every = found.withColumn("slot", F.lit(-1).cast("long")).unionByName(kept)
    return every.groupBy("anchor_id").applyInArrow(windows_of, out)
