"""Event effects: batch and stream against the worked example."""

import random
from datetime import timedelta

import pandas as pd
import pytest

from tesserine import App, CreatedAtField, CustomSpace, Effect, EventSchema, Float, FloatList, IdField, Index, InMemorySource, Integer, Mode, NumberSpace, Query, Schema, SchemaError, SchemaReference, String
from tesserine.operators.effects import Rule, Tally, rule_of, shares
from tesserine.sources.store import persist, restore
from tesserine.streaming.effects import advance, batch_states, ordered_effects, run_available, stream_effects, with_values

DAY = 86400


class User(Schema):
    id: IdField
    taste: FloatList
    age: Float | None


class Item(Schema):
    id: IdField
    v: FloatList
    price: Float | None


class Event(EventSchema):
    id: IdField
    created_at: CreatedAtField
    item: SchemaReference[Item]
    user: SchemaReference[User]
    kind: String


user, item, event = User(), Item(), Event()
ITEMS = [dict(id="p1", v=[1, 0, 0], price=1.0), dict(id="p2", v=[0, 1, 0], price=5.0), dict(id="p3", v=[0, 0, 1], price=9.0)]
EVENTS = [dict(id="e1", created_at=998 * DAY, item="p2", user="u", kind="read"), dict(id="e2", created_at=999 * DAY, item="p3", user="u", kind="read"), dict(id="e3", created_at=999 * DAY, item="p1", user="u", kind="skip"), dict(id="e4", created_at=1, item="gone", user="u", kind="read"), dict(id="e5", created_at=1, item="p1", user="nobody", kind="read")]


def build(spark, **options):
    space = CustomSpace([user.taste, item.v], 3)
    index = Index(space, effects=[Effect(space, event.user, 0.8 * event.item, event.kind == "read")], **options)
    sources = [InMemorySource(s) for s in (user, item, event)]
    app = App(spark, sources, [index], now=1000 * DAY)
    for s, rows in zip(sources, ([dict(id="u", taste=[1, 0, 0]), dict(id="quiet", taste=[0, 1, 0])], ITEMS, EVENTS)):
        s.put(rows)
    return app, index, space


@pytest.mark.parametrize(
    "options,want",
    [
        (dict(temperature=0.25, event_influence=0.5), (0.845154, 0.507093, 0.169031)), (dict(temperature=0.25, event_influence=1.0), (0, 0.948683, 0.316228)),
        (dict(temperature=0.5, event_influence=0.5), (0.870388, 0.348155, 0.348155)), (dict(temperature=0.75, event_influence=0.5), (0.845154, 0.169031, 0.507093)),
        (dict(temperature=0.75, event_influence=1.0), (0, 0.316228, 0.948683)), (dict(temperature=0.5, event_influence=0.0), (1.0, 0, 0)),
        (dict(temperature=0.5, event_influence=1.0, time_decay_floor=0.0, max_age=timedelta(days=4)), (0, 0.529999, 0.847998)), (dict(temperature=0.5, event_influence=1.0, max_age=timedelta(days=1)), (0, 0, 1.0)),
        (dict(temperature=0.0, event_influence=0.5), (1.0, 0, 0)), (dict(temperature=0.5, event_influence=1.0, max_count=1), (0, 0, 1.0)),
    ],
)
def test_worked_example(spark, options, want):
    app, index, _ = build(spark, **options)
    got = {r.id: [round(x, 6) for x in r.vector] for r in app.vectors(index, user).collect()}
    assert got["u"] == pytest.approx(want, abs=2e-6) and got["quiet"] == [0, 1, 0]


def test_look_alike_of_a_user_with_events(spark):
    app, index, _ = build(spark, temperature=0.75, event_influence=1.0)
    rows = app.query(Query(index).find(item).with_vector(user, "u")).frame.collect()
    assert [r.id for r in rows] == ["p3", "p2", "p1"]


def test_numbers_average(spark):
    space = NumberSpace([user.age, item.price], 0, 10, Mode.SIMILAR)
    index = Index(space, effects=[Effect(space, event.user, event.item, event.kind == "read")], temperature=0.5, event_influence=0.5)
    sources = [InMemorySource(s) for s in (user, item, event)]
    app = App(spark, sources, [index], now=1000 * DAY)
    for s, rows in zip(sources, ([dict(id="u", taste=[1, 0, 0], age=3.0)], ITEMS, EVENTS)):
        s.put(rows)
    assert app.rows(index, user).first()[index.raw_column(space)] == pytest.approx(0.5 * 7 + 0.5 * 3)


def test_stream_equals_batch(spark, tmp_path):
    app, index, space = build(spark, temperature=0.25, event_influence=1.0)
    inbox = str(tmp_path / "in")
    events = app.tables[event]
    events.filter("id in ('e1', 'e4')").coalesce(1).write.mode("append").json(inbox)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).json(inbox)
    persist(index.rows(item, app.tables[item]), str(tmp_path / "items"))
    ready = with_values(stream, restore(spark, str(tmp_path / "items")), space, index.raw_column(space), "user", "item", index.effects)
    out = stream_effects(ready, rule_of(index, 1000 * DAY), watermark="3650 days")
    query = out.writeStream.outputMode("update").format("memory").queryName("fold").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    events.filter("id = 'e2'").coalesce(1).write.mode("append").json(inbox)
    query.processAllAvailable()
    query.stop()
    rows = spark.table("fold").filter("entity = 'u'").orderBy("count").collect()
    assert [r["count"] for r in rows] == [1, 2] and rows[-1].average == 86270400 and rows[-1].oldest == 86227200
    assert rows[-1].value == pytest.approx([0, 0.6, 0.2])


@pytest.mark.parametrize("rule", [Rule(0.5, 2000), Rule(0.9, 2000, max_age=900, floor=0.2), Rule(0.0, 2000), Rule(0.3, 1500, floor=0.0)])
def test_shares_of_long_and_short_entities(spark, rule):
    """Stretches of seven events: entities of one stretch, of many, and that end where a stretch ends."""
    rng = random.Random(3)
    sizes = {"a": 1, "b": 7, "hot": 500, "c": 6, "d": 14, "e": 40}
    events = [(u, rng.randint(1, 1900), f"{u}{i}", f"i{rng.randint(0, 9)}", rng.randint(1, 2), rng.choice([1.0, 0.5])) for u, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(events, "entity string, created_at long, event string, by string, m int, weight double").repartition(3)
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        got = {(r.entity, r.by): r.share for r in shares(df, rule).groupBy("entity", "by").sum("share").withColumnRenamed("sum(share)", "share").collect()}
    finally:
        spark.conf.set(key, old)
    want = {}
    for u in sizes:
        tally, vec = Tally(), {}
        for _, at, _, by, m, w in sorted((e for e in events if e[0] == u), key=lambda e: (e[1], e[2])):
            keep, add = rule.step(tally, at, m)
            vec = {k: v * keep for k, v in vec.items()}
            vec[by] = vec.get(by, 0.0) + add * w
        want |= {(u, k): v for k, v in vec.items()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_one_sort_per_fold(spark):
    app, index, _ = build(spark)
    plan = app.rows(index, user)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and app.rows(index, user) is app.rows(index, user)


def test_stream_orders_late_events_and_starts_from_history(spark, tmp_path):
    """Files in the wrong order, an event that comes twice, and a history folded in a batch."""
    rule, rng = Rule(0.4, 10_000 * DAY, floor=0.5), random.Random(5)
    rows = [(rng.choice("abc"), (i + 1) * 3600, f"e{i:03}", rng.randint(1, 2), 0.5, [float(rng.randint(0, 9)), 1.0]) for i in range(60)]
    schema = "entity string, created_at long, event string, m long, weight double, raw array<double>"
    want = {r.entity: r for r in batch_states(spark.createDataFrame(rows, schema).repartition(3), rule).collect()}
    tallies = {u: Tally() for u in "abc"}
    for u in "abc":
        vec = advance(tallies[u], None, pd.DataFrame([r for r in rows if r[0] == u], columns=["entity", "created_at", "event", "m", "weight", "raw"]), rule)
        assert want[u].value == pytest.approx(vec.tolist()) and (want[u]["count"], want[u].average) == (tallies[u].count, tallies[u].average)
    history, late = rows[:20], rows[20:]
    start = batch_states(spark.createDataFrame(history, schema), rule)
    for n, part in enumerate((late[25:], late[:12], late[12:25] + late[30:31], [("d", 60 * 3600, "x1", 1, 1.0, [4.0, 4.0])])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    got = {r.entity: r for r in run_available(ordered_effects(stream, rule, "30 hours", start), f"{tmp_path}/out").collect()}
    assert set(got) >= {u for u in "abc"} and got["d"].value == [4.0, 4.0]
    for u in "abc":
        assert (got[u]["count"], got[u].average, got[u].oldest) == (want[u]["count"], want[u].average, want[u].oldest)
        assert got[u].value == pytest.approx(want[u].value)


def test_validation():
    space = CustomSpace([user.taste, item.v], 3)
    with pytest.raises(SchemaError):
        Index(space, temperature=2)
    with pytest.raises(SchemaError):
        Index(space, max_age=timedelta(0))
    with pytest.raises(SchemaError):
        0 * event.item
    with pytest.raises(SchemaError):
        Index(CustomSpace(user.taste, 3), effects=[Effect(space, event.user, event.item)])

    class Bad(EventSchema):
        id: IdField
        created_at: CreatedAtField
        n: Integer | None

    with pytest.raises(SchemaError):
        Bad()
