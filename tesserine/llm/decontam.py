"""Benchmark decontamination by spaced-seed hashing, with DataFrame operations only.

A document holds a benchmark passage when, at some alignment, at least ``WINDOW - SUBS`` of
``WINDOW`` consecutive token positions are equal. Each fixed mask keeps six of its token
positions and ignores the others; the two masks together are lossless: whichever two of the 13
positions differ, one mask fits into the window without touching them. The hashes of the kept
positions of all documents meet those of the benchmark, and the tokens around every hit are
compared position by position.

A benchmark of up to ``BLOCK_SEEDS`` seeds is broadcast whole. Of a larger one only the distinct
hashes are, ``BLOCK_KEYS`` at a time: they let the few positions through that have a seed, which
are written and meet the seeds by a join that splits frequent hashes. Only a benchmark of many
millions of seeds reads the documents more than once. Nothing else is joined before the few hits,
so neither frequent passages nor long documents gather in one task.

Tokens are the runs of letters and digits of the lower-cased text. Items of 5 to 10 tokens count
when they occur whole and unchanged; shorter ones are no evidence and match nothing.

Defined cases: null and empty texts hold no passage; rows that share an id, null included, share
their verdict; an empty benchmark or an empty table gives no contamination.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import spread_join, write_table

WINDOW, SUBS = 13, 2
#: Kept positions of the masks.
MASKS = ((0, 1, 3, 6, 7, 8), (0, 1, 3, 4, 5, 6))
SHORTEST = 5
#: Seeds that are broadcast with their surroundings (at most 25 token hashes and three numbers each), and hashes that are broadcast alone.
BLOCK_SEEDS, BLOCK_KEYS = 100_000, 4_000_000


def _tokens(text: Column) -> Column:
    """64-bit hashes of the tokens."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed_keys(tokens: Column, pos: Column, masks: list[tuple[int, ...]]) -> Column:
    """One hash per mask that fits at ``pos``; null where it doesn't fit."""
    return F.array(*[
        F.when(pos + m[-1] < F.size(tokens), F.xxhash64(F.lit(i), *[F.get(tokens, pos + o) for o in m])) for i, m in enumerate(masks)
    ])


def _positions(df: DataFrame, columns: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """A row per token position and mask that fits: columns, tokens, pos, mask, key."""
    at = df.filter(F.size("tokens") > 0).select(*columns, "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("pos"))
    return at.select(*columns, "tokens", "pos", F.posexplode(_seed_keys(F.col("tokens"), F.col("pos"), masks)).alias("mask", "key")).filter("key is not null")


def passage_hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified hits: ``doc`` (the id), item, and best, the equal tokens of the best window around the hit."""
    items = benchmark.select(F.col(item_col).alias("item"), _tokens(F.col(item_text)).alias("tokens")).filter(F.size("tokens") >= SHORTEST)
    whole = WINDOW - SUBS  # items below this many tokens must occur whole
    short = sorted(r[0] for r in items.filter(F.size("tokens") < whole).select(F.size("tokens")).distinct().collect())  # at most six lengths
    masks = [*MASKS, *(tuple(range(n)) for n in short)]
    size = F.size("tokens")
    fits = reduce(lambda a, b: a | b, [(F.col("mask") == i) & ((size >= whole) if i < len(MASKS) else (size == len(masks[i]))) for i in range(len(masks))])
    reach = WINDOW - 1
    seeds = (
        _positions(items, ["item"], masks).filter(fits)
        .select("key", "item", F.when(size < whole, size).otherwise(0).alias("exact"), F.least(F.lit(reach), F.col("pos")).alias("lead"),
                F.slice("tokens", F.greatest(F.lit(1), F.col("pos") + 1 - reach), 2 * reach + 1).alias("near"))
        .withColumn("near", F.slice("near", 1, F.col("lead") + WINDOW))
    )
    documents = df.select(F.col(id_col).alias("doc"), _tokens(F.col(text_col)).alias("tokens"))
    spots = _positions(documents, ["doc"], masks).select("doc", "tokens", "pos", "key")

    def equal(k: Column) -> Column:
        return F.get("around", F.col("before") + k - reach) == F.get("near", F.col("lead") + k - reach)

    bits = F.aggregate(F.sequence(F.lit(0), F.lit(2 * reach)), F.lit(0).cast("long"), lambda acc, k: F.when(F.coalesce(equal(k), F.lit(False)), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))).otherwise(acc))
    window = lambda s: F.bit_count(F.shiftright("bits", s).bitwiseAND(F.lit((1 << WINDOW) - 1)))
    run = F.shiftright("bits", reach)
    exact = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("exact")) - 1
    # the generator is a barrier: a hit takes its surroundings along, not the tokens of its document
    around = F.explode(F.array(F.slice("tokens", F.greatest(F.lit(1), F.col("pos") + 1 - reach), 2 * reach + 1)))
    before = F.least(F.lit(reach), F.col("pos"))
    if seeds.count() <= BLOCK_SEEDS:
        met = spots.join(F.broadcast(seeds), "key").select("doc", "item", "exact", "lead", "near", before.alias("before"), around.alias("around"))
    else:
        seeds = write_table(seeds)
        keys = seeds.select("key").distinct()
        blocks = -(-keys.count() // BLOCK_KEYS)
        parts = [keys.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i) for i in range(blocks)]
        some = [spots.join(F.broadcast(part), "key", "left_semi").select("doc", "key", before.alias("before"), around.alias("around")) for part in parts]
        met = spread_join(write_table(reduce(DataFrame.union, some)), seeds, "key")
    hits = met.select("doc", "item", "exact", bits.alias("bits"))
    best = F.when(F.col("exact") > 0, F.when(run.bitwiseAND(exact) == exact, F.col("exact")).otherwise(0)).otherwise(F.greatest(*[window(s) for s in range(WINDOW)]))
    return hits.select("doc", "item", "exact", best.alias("best")).filter((F.col("best") >= whole) | (F.col("exact") > 0) & (F.col("best") > 0)).select("doc", "item", F.col("best").cast("long").alias("best"))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, contaminated, n_items, items (ids of the passages it holds, ascending, comma-joined), best."""
    hits = passage_hits(df, benchmark, id_col, text_col, item_col, item_text)
    per = hits.groupBy("doc", "item").agg(F.max("best").alias("best"))
    per = per.groupBy("doc").agg(F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x.cast("string")), ",").alias("items"), F.max("best").alias("best"))
    ids = df.select(F.col(id_col).alias("_id"))
    joined = ids.join(per, ids["_id"].eqNullSafe(per["doc"]), "left")
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"),
        F.coalesce("best", F.lit(0).cast("long")).alias("best"),
    )
