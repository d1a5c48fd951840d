"""Event effects on a stream: one state per entity, the same rule as the batch form.

Rows enter with the affecting entity's raw value beside them (a stream-static join before), in
micro-batches. ``stream_effects`` takes events as they come: inside a batch by (created_at, event id),
across batches in the order of arrival; its state is the tally and the running vector.
``ordered_effects`` lets events wait until the watermark has passed them, so that late ones act in
their place, and can start from the batch fold of a history.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tesserine.operators.effects import Rule, Tally, matching
from tesserine.operators.index import Effect
from tesserine.operators.spaces import Space

STATE = T.StructType([T.StructField("count", T.LongType()), T.StructField("average", T.LongType()), T.StructField("oldest", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
OUT = T.StructType([T.StructField("entity", T.StringType()), T.StructField("count", T.LongType()), T.StructField("average", T.LongType()), T.StructField("oldest", T.LongType()), T.StructField("value", T.ArrayType(T.DoubleType()))])


def advance(tally: Tally, vec: np.ndarray | None, events: pd.DataFrame, rule: Rule) -> np.ndarray | None:
    """Take a sorted batch of one entity's events (created_at, m, weight, raw) in."""
    return folded(tally, vec, zip(events["created_at"], events["m"], events["weight"], events["raw"]), rule)


def folded(tally: Tally, vec: np.ndarray | None, events: Iterable[tuple], rule: Rule) -> np.ndarray | None:
    """As ``advance``, for tuples."""
    for at, m, weight, raw in events:
        keep, add = rule.step(tally, int(at), int(m))
        a = np.asarray(raw, float) * weight
        vec = a * add if vec is None else vec * keep + a * add
    return vec


def with_values(events: DataFrame, affecting: DataFrame, space: Space, raw: str, affected: str, reference: str, effects: list[Effect]) -> DataFrame:
    """Event rows ready for the fold: entity, created_at, event, m, weight and the affecting raw value as an array."""
    n, weight = matching(effects)
    value = F.array(F.col(raw)) if space.scalar else F.col(raw)
    known = affecting.filter(F.col(raw).isNotNull()).select(F.col("id").alias("by"), value.alias("raw"))
    acting = events.withColumn("m", n).filter(F.col("m") > 0)
    acting = acting.select(F.col(affected).alias("entity"), "created_at", F.col("id").alias("event"), F.col(reference).alias("by"), "m", F.lit(1.0).alias("weight") if space.scalar else weight.alias("weight"))
    return acting.filter("entity is not null").join(known, "by").drop("by")


def stream_effects(acting: DataFrame, rule: Rule, watermark: str | None = None) -> DataFrame:
    """Updates (entity, count, average, oldest, value) per micro-batch; write with output mode ``update``.

    With ``watermark`` (such as ``"1 hour"``) repeated event ids inside it count once.
    """
    if watermark:
        acting = acting.withColumn("_time", F.timestamp_seconds("created_at")).withWatermark("_time", watermark).dropDuplicatesWithinWatermark(["event"]).drop("_time")

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tally, vec = Tally(), None
        if state.exists:
            tally.count, tally.average, tally.oldest, held = state.get
            vec = np.array(held, float)
        for events in batches:
            vec = advance(tally, vec, events.sort_values(["created_at", "event"], kind="stable"), rule)
        state.update((tally.count, tally.average, tally.oldest, vec.tolist()))
        yield pd.DataFrame({"entity": [key[0]], "count": [tally.count], "average": [tally.average], "oldest": [tally.oldest], "value": [vec.tolist()]})

    return acting.groupBy("entity").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


# With late events in order, timers and a start from the batch fold ---------------------------------------------
PENDING = T.StructType([T.StructField("created_at", T.LongType()), T.StructField("event", T.StringType()), T.StructField("m", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("raw", T.ArrayType(T.DoubleType()))])

#: What the fold takes of a waiting event.
ACTING = itemgetter(0, 2, 3, 4)


def batch_states(acting: DataFrame, rule: Rule) -> DataFrame:
    """(entity, count, average, oldest, value) after all of ``acting`` (see ``with_values``), for a stream to start from.

    One sort by entity and order; a task holds one entity's state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally, vec = None, Tally(), None

        def done():
            return pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip(([now], [tally.count], [tally.average], [tally.oldest], [vec.tolist()]), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())))], names=OUT.names)

        for batch in batches:
            entities, at, _, *rest = (c.to_pylist() for c in batch.columns)
            cuts = [0, *[i for i in range(1, len(entities)) if entities[i] != entities[i - 1]], len(entities)]
            for lo, hi in zip(cuts[:-1], cuts[1:]) if entities else ():
                if entities[lo] != now:
                    if vec is not None:
                        yield done()
                    now, tally, vec = entities[lo], Tally(), None
                vec = folded(tally, vec, zip(at[lo:hi], *(x[lo:hi] for x in rest)), rule)
        if vec is not None:
            yield done()

    rows = acting.select(F.col("entity").cast("string").alias("entity"), "created_at", "event", "m", "weight", "raw")
    return rows.repartition("entity").sortWithinPartitions("entity", "created_at", "event").mapInArrow(run, OUT)


class EffectFold(StatefulProcessor):
    """One entity's fold: what can no longer be preceded is in the state, the rest waits for the watermark.

    Every batch tells the value with all that has come so far; timers fold what has waited long enough
    also where an entity gets no more events.
    """

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", STATE)
        self.waiting = handle.getListState("waiting", PENDING)

    def _state(self) -> tuple[Tally, np.ndarray | None]:
        held = self.settled.get()
        if held is None:
            return Tally(), None
        count, average, oldest, vec = held
        return Tally(count, average, oldest), np.array(vec, float)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        self.settled.update((r["count"], r["average"], r["oldest"], list(r["value"])))

    def _settle(self, events: list[tuple], until: int) -> tuple[Tally, np.ndarray | None, list[tuple]]:
        """Fold the events before ``until`` (milliseconds) into the state; the rest is returned in order."""
        events = sorted({e[1]: e for e in reversed(events)}.values(), key=lambda e: e[:2])  # of an event's rows the first
        ready = bisect_left(events, until, key=lambda e: e[0] * 1000)
        tally, vec = self._state()
        if ready:
            vec = folded(tally, vec, map(ACTING, events[:ready]), self.rule)
            self.settled.update((tally.count, tally.average, tally.oldest, vec.tolist()))
        return tally, vec, events[ready:]

    def _wait(self, held: list[tuple], rest: list[tuple]) -> None:
        """Let ``rest`` wait; where all that waited still does, only what is new is written."""
        names = {e[1] for e in held}
        if len(rest) >= len(names) and names <= {e[1] for e in rest} and len(names) == len(held):
            new = [e for e in rest if e[1] not in names]
            if new:
                self.waiting.appendList(new)
        elif rest:
            self.waiting.put(rest)
        elif held:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [(r["created_at"], r["event"], r["m"], r["weight"], list(r["raw"])) for r in rows]
        held = [tuple(e) for e in self.waiting.get()]
        tally, vec, rest = self._settle(held + came, timerValues.getCurrentWatermarkInMs())
        self._wait(held, rest)
        if rest:
            self.handle.registerTimer(rest[-1][0] * 1000 + 1)
        vec = folded(tally, vec, map(ACTING, rest), self.rule)
        yield Row(entity=key[0], count=tally.count, average=tally.average, oldest=tally.oldest, value=vec.tolist())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = [tuple(e) for e in self.waiting.get()]
        self._wait(held, self._settle(held, timerValues.getCurrentWatermarkInMs())[2])
        return iter([])


def ordered_effects(acting: DataFrame, rule: Rule, delay: str = "1 day", initial: DataFrame | None = None) -> DataFrame:
    """Updates as of ``stream_effects``, equal to the batch fold whatever the order in which events come, up to ``delay`` late.

    ``initial`` (see ``batch_states``) is where entities start; its events must be older than those of the stream. Events that
    are later than ``delay`` are dropped. Needs the RocksDB state store (``rocksdb_states``).
    """
    timed = acting.withColumn("_time", F.timestamp_seconds("created_at")).withWatermark("_time", delay)
    timed = timed.select(F.col("entity").cast("string").alias("entity"), "created_at", F.col("event").cast("string").alias("event"), F.col("m").cast("long").alias("m"), "weight", "raw", "_time")
    start = initial.select(*OUT.names).groupBy("entity") if initial is not None else None
    return timed.groupBy("entity").transformWithState(EffectFold(rule), OUT, "Update", "EventTime", start)


@contextmanager
def rocksdb_states(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_available(updates: DataFrame, path: str) -> DataFrame:
    """Run a stream over all there is, writing each batch's updates under ``path``; the last row of every entity."""
    spark = updates.sparkSession
    with rocksdb_states(spark):
        query = (
            updates.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
            .foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/updates/batch={n}")).start()
        )
        query.awaitTermination()
    found = spark.read.schema(T.StructType([*OUT.fields, T.StructField("batch", T.LongType())])).option("recursiveFileLookup", "true").parquet(f"{path}/updates")
    last = F.max_by(F.struct(*OUT.names[1:]), "batch").alias("s")
    return found.groupBy("entity").agg(last).select("entity", "s.*")
