"""Event effects: interactions move the vectors of the entities that they name.

Events of an entity act in the order of (created_at, event id). The rule is a chain
``vec' = (T a + s vec) / (T + s)`` whose factors depend only on counts and times, so the batch form
needs no entity's vectors in one place: one pass over sorted, narrow rows yields the share that each
event has in the final vector, added up by affecting entity, and the vectors are summed with
these shares under ordinary partial aggregation. The streaming form keeps the same state per
entity (see ``tesserine.streaming.effects``).

Defined cases: events whose condition fails, whose affecting entity is missing or has no vector,
or that name no entity change nothing; entities without events keep their own vector; repeated
events count each time unless ``distinct_events`` is set.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tesserine.operators.index import Effect, Index
from tesserine.operators.spaces import Space
from tesserine.schema import Schema, condition
from tesserine.sources.store import write_shared


@dataclass
class Tally:
    """What the chain remembers of an entity's events besides the vector."""

    count: int = 0
    average: int = 0
    oldest: int = 0


@dataclass(frozen=True)
class Rule:
    """The parameters of the chain."""

    temperature: float
    now: int
    max_age: int = 0
    floor: float = 1.0

    def step(self, t: Tally, created_at: int, matches: int) -> tuple[float, float]:
        """Take one event in; the factors (keep, add) of ``vec' = keep * vec + add * a``."""
        first = t.count == 0
        count = t.count + matches
        t.average = -(-(t.average * t.count + created_at * matches) // count)
        t.oldest = min(t.oldest, created_at) if t.oldest else created_at
        t.count = count
        if first:
            return 0.0, float(self.temperature > 0)
        age, old = self.max_age or self.now - t.oldest, self.now - t.average
        decay = 1.0 if age == 0 else 0.0 if age < old else (1 - old / age) * (1 - self.floor) + self.floor
        stored = decay * (count - 1) * (1 - self.temperature)
        total = self.temperature + stored
        return (stored / total, self.temperature / total) if total else (0.0, 0.0)


def rule_of(index: Index, now: int) -> Rule:
    return Rule(index.temperature, now, int(index.max_age.total_seconds()) if index.max_age else 0, index.time_decay_floor)


def matching(effects: list[Effect]) -> tuple[Column, Column]:
    """How many effects an event satisfies and the mean of their weights."""
    each = []
    for e in effects:
        ok = F.lit(True) if e.when is None else condition([[(p, p.value) for p in e.when.members]])
        each.append(F.when(ok, F.lit(e.weight)))
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in each])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in each])
    return n, total / n


def groups_of(index: Index, schema: Schema) -> list[tuple[Space, Schema, str, str, type, list[Effect]]]:
    """Effects on ``schema`` that are taken together: (space, events, affected column, affecting column, affecting schema, effects)."""
    out: dict[tuple, list] = {}
    for e in index.effects:
        if isinstance(schema, e.affected_reference.target or object):
            key = (index.position(e.space), e.affected_reference.schema, e.affected_reference.name, e.affecting_reference.name)
            out.setdefault(key, []).append(e)
    return [(index.spaces[i], events, affected, affecting, es[0].affecting_reference.target, es) for (i, events, affected, affecting), es in out.items()]


SHARES = T.StructType([T.StructField("entity", T.StringType()), T.StructField("by", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("part", T.LongType()), T.StructField("later", T.DoubleType())])


def shares(acting: DataFrame, rule: Rule) -> DataFrame:
    """(entity, by, share): what the affecting entities' values count in each entity's final one.

    ``acting``: (entity, created_at, event, by, m, weight). One sort by entity and order; a task keeps one
    tally and goes over each stretch of an entity's events (those of one Arrow batch) twice: forwards
    for the factors, backwards for their products. An entity whose events fill several stretches leaves
    them with numbers, and at its end one row per stretch with the product of all later factors, which
    is joined: the rows of that join's other side are fewer than the events by the size of a batch.
    """
    arrow = pa.schema([pa.field(f.name, {"StringType": pa.string(), "DoubleType": pa.float64(), "LongType": pa.int64()}[type(f.dataType).__name__]) for f in SHARES])

    def stretch(by: list, weight: np.ndarray, keep: np.ndarray, add: np.ndarray) -> tuple[list, np.ndarray, float]:
        """Affecting entities, their shares at the stretch's end, and the product of its factors."""
        after = np.concatenate([np.cumprod(keep[::-1])[::-1], [1.0]])
        names, of = np.unique(np.array(by), return_inverse=True)
        return names.tolist(), np.bincount(of, weights=add * weight * after[1:], minlength=len(names)), float(after[0])

    def rows(entity: str, names: list, values: np.ndarray, part: int | None) -> pa.RecordBatch:
        n = len(names)
        return pa.RecordBatch.from_arrays([pa.array([entity] * n, pa.string()), pa.array(names, pa.string()), pa.array(values), pa.array([part] * n, pa.int64()), pa.nulls(n, pa.float64())], schema=arrow)

    def closing(entity: str, products: list[float]) -> pa.RecordBatch:
        later = np.concatenate([np.cumprod(np.array(products)[::-1])[::-1][1:], [1.0]])
        n = len(products)
        return pa.RecordBatch.from_arrays([pa.array([entity] * n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.array(range(n), pa.int64()), pa.array(later)], schema=arrow)

    def run(batches):
        now, tally, waiting, products = None, Tally(), None, []

        def end():
            """What is left of an entity once no more of its events can come."""
            if products:
                yield rows(now, *waiting[:2], len(products))
                yield closing(now, [*products, waiting[2]])
            elif waiting:
                yield rows(now, *waiting[:2], None)

        for batch in batches:
            entities, at, by, m, weight = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("entity", "created_at", "by", "m", "weight"))
            cuts = [0, *[i for i in range(1, len(entities)) if entities[i] != entities[i - 1]], len(entities)]
            for lo, hi in zip(cuts[:-1], cuts[1:]) if entities else ():
                if entities[lo] != now:
                    yield from end()
                    now, tally, waiting, products = entities[lo], Tally(), None, []
                elif waiting:
                    yield rows(now, *waiting[:2], len(products))
                    products.append(waiting[2])
                steps = np.array([rule.step(tally, t, n) for t, n in zip(at[lo:hi], m[lo:hi])])
                waiting = stretch(by[lo:hi], np.array(weight[lo:hi]), steps[:, 0], steps[:, 1])
        yield from end()

    made = acting.repartition("entity").sortWithinPartitions("entity", "created_at", "event").mapInArrow(run, SHARES)
    made = write_shared(made)  # read twice: shares, and products of long entities
    later = made.filter("by is null").select("entity", "part", "later")
    own = made.filter("by is not null").drop("later")
    if later.isEmpty():
        return own.select("entity", "by", "share")
    return own.join(later, ["entity", "part"], "left").select("entity", "by", (F.col("share") * F.coalesce("later", F.lit(1.0))).alias("share"))


def event_values(events: DataFrame, affecting: DataFrame, space: Space, raw: str, affected: str, reference: str, effects: list[Effect], rule: Rule, distinct_events: bool = False, max_count: int | None = None) -> DataFrame:
    """(entity, value): the raw value that events alone give each affected entity.

    ``max_count`` keeps an entity's last events only.
    """
    n, weight = matching(effects)
    if distinct_events:
        events = events.dropDuplicates(["id"])
    acting = events.withColumn("m", n).filter(F.col("m") > 0).select(F.col(affected).alias("entity"), "created_at", F.col("id").alias("event"), F.col(reference).alias("by"), "m", weight.alias("weight"))
    known = affecting.select(F.col("id").alias("by"), F.col(raw).alias("raw")).filter(F.col("raw").isNotNull())
    acting = acting.filter(F.col("entity").isNotNull()).join(known.select("by"), "by", "left_semi")
    if max_count:
        last = Window.partitionBy("entity").orderBy(F.desc("created_at"), F.desc("event"))
        acting = acting.withColumn("nth", F.row_number().over(last)).filter(F.col("nth") <= max_count).drop("nth")
    if space.scalar:
        acting = acting.withColumn("weight", F.lit(1.0))
    both = shares(acting, rule).filter("share <> 0").groupBy("entity", "by").agg(F.sum("share").alias("share")).join(known, "by")
    if space.scalar:
        return both.groupBy("entity").agg((F.sum(F.col("share") * F.col("raw")) / F.sum("share")).alias("value"))
    parts = both.select("entity", *[(F.col("share") * F.get("raw", F.lit(i))).alias(f"d{i}") for i in range(space.length)])
    return parts.groupBy("entity").agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(space.length)]).select("entity", F.array(*[f"d{i}" for i in range(space.length)]).alias("value"))


def apply_effects(index: Index, schema: Schema, rows: DataFrame, tables: dict[Schema, DataFrame], events: dict[Schema, DataFrame], now: int, distinct_events: bool = False) -> DataFrame:
    """Indexed ``rows`` of ``schema`` with the raw values that the events leave them with.

    Final value: ``event_influence`` per group of effects against the entity's own value, brought
    back to the space's norm. ``tables`` holds indexed rows by schema, ``events`` event rows.
    """
    rule, by_space = rule_of(index, now), {}
    for space, event_schema, affected, reference, target, effects in groups_of(index, schema):
        source = next(df for s, df in tables.items() if isinstance(s, target or object))
        raw = index.raw_column(space)
        values = event_values(events[event_schema], source, space, raw, affected, reference, effects, rule, distinct_events, index.max_count)
        name = f"__event_{len(sum(by_space.values(), []))}"
        rows = rows.join(values.select(F.col("entity").alias("id"), F.col("value").alias(name)), "id", "left")
        by_space.setdefault(index.position(space), []).append(name)
    e = index.event_influence
    for i, names in by_space.items():
        space, raw = index.spaces[i], f"__raw_{i}"
        any_event = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names])
        if space.scalar:
            pairs = [(F.col(n), F.lit(e)) for n in names] + [(F.col(raw), F.lit(1 - e))]
            top = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in pairs])
            low = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), w).otherwise(0.0) for v, w in pairs])
            mixed = F.when(low != 0, top / low)
        else:
            zero = F.array_repeat(F.lit(0.0), space.length)
            parts = [(F.coalesce(F.col(n), zero), e) for n in names] + [(F.coalesce(F.col(raw), zero), 1 - e)]
            mixed = space.normal(F.array(*[reduce(lambda a, b: a + b, [F.get(v, F.lit(d)) * w for v, w in parts]) for d in range(space.length)]))
        rows = rows.withColumn(raw, F.when(any_event, mixed).otherwise(F.col(raw)))
    return rows.drop(*sum(by_space.values(), []))
