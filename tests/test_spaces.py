"""Scores of every space against hand-computed values."""

import math
from datetime import timedelta

import numpy as np
import pytest

from tesserine import (
    App, CategoricalSimilaritySpace, CustomSpace, Float, FloatList, IdField, Index, InMemorySource, InputAggregation, Integer, LogarithmicScale, Mode, NumberSpace, Param, PeriodTime, Query, RecencySpace, Schema,
    SchemaError, String, StringList, TextSimilaritySpace, Timestamp,
)

NOW = 1723248000  # 2024-08-10
DAY = 86400


def engine(spark, schema, index, rows, now=NOW):
    source = InMemorySource(schema)
    app = App(spark, [source], [index], now=now)
    source.put(rows)
    return app


def scores(result):
    return {r.id: round(r.score, 6) for r in result.frame.collect()}


class Product(Schema):
    id: IdField
    name: String
    category: StringList | None


product = Product()
ROWS = [("1", "T-shirt", ["Clothing"]), ("2", "Running Shoes", ["Clothing", "Sports"]), ("3", "Yoga Mat", ["Sports"]), ("4", "Pijama", ["Clothing", "Home"]), ("5", "Pillows", ["Home"]), ("6", "Blender", ["Kitchen"]), ("7", "Cooking Apron", ["Clothing", "Kitchen"]), ("8", "Nothing", None)]
GOODS = [dict(id=i, name=n, category=c) for i, n, c in ROWS]


def named(result):
    names = {i: n for i, n, _ in ROWS}
    return {names[k]: v for k, v in scores(result).items()}


def test_categories(spark):
    space = CategoricalSimilaritySpace(product.category, ["Clothing", "Sports", "Home"])
    index = Index(space)
    app = engine(spark, product, index, GOODS)
    one = named(app.query(Query(index).find(product).similar(space, ["Clothing"])))
    assert one == {n: float("Clothing" in (c or [])) for _, n, c in ROWS}
    two = named(app.query(Query(index).find(product).similar(space, ["Clothing", "Home"])))
    assert two["Pijama"] == 1.0 and two["T-shirt"] == 0.5 and two["Cooking Apron"] == 0.5 and two["Yoga Mat"] == 0
    other = named(app.query(Query(index).find(product).similar(space, "Electronics")))
    assert {n for n, s in other.items() if s == 1.0} == {"Blender", "Cooking Apron"}
    for minus, pillows in ((-1.0, -0.5), (-4.0, -2.0)):
        got = named(app.query(Query(index).find(product).similar(space, ["Clothing", "Sports"]).similar(space, ["Home"], minus)))
        assert got["Running Shoes"] == 1.0 and got["T-shirt"] == got["Yoga Mat"] == got["Cooking Apron"] == 0.5 and got["Blender"] == 0 and got["Pillows"] == pillows
    strict = CategoricalSimilaritySpace(product.category, ["Clothing", "Sports", "Home"], uncategorized_as_category=False)
    index = Index(strict)
    app = engine(spark, product, index, GOODS)
    assert set(named(app.query(Query(index).find(product).similar(strict, ["Kitchen"]))).values()) == {0.0}
    negative = CategoricalSimilaritySpace(product.category, ["Clothing", "Sports", "Home"], negative_filter=-0.5)
    index = Index(negative)
    app = engine(spark, product, index, GOODS)
    got = named(app.query(Query(index).find(product).similar(negative, ["Clothing", "Home"])))
    assert got["T-shirt"] == round(0.5 - 0.5 * math.sqrt(3) / 2, 6) and got["Nothing"] == 0


class Person(Schema):
    id: IdField
    height: Float | None
    debt: Float | None


def test_numbers(spark):
    person = Person()
    tall = NumberSpace(person.height, 100, 200, Mode.MAXIMUM)
    poor = NumberSpace(person.debt, 0, 1e6, Mode.MINIMUM, scale=LogarithmicScale())
    index = Index([tall, poor])
    app = engine(spark, person, index, [dict(id="person1", height=190, debt=1e6), dict(id="person2", height=150, debt=1e3), dict(id="person3", height=150, debt=0), dict(id="person4")])
    q = Query(index, weights={tall: 1.0, poor: 1.0}).find(person).include_metadata()
    result = app.query(q).frame.collect()
    assert [r.id for r in result] == ["person3", "person2", "person1", "person4"]
    assert [round(r.score, 6) for r in result] == [0.853553, 0.707067, 0.493844, 0.0]
    assert all(abs(sum(r.partial_scores) - r.score) < 1e-12 for r in result)
    assert [round(x, 6) for x in result[0].partial_scores] == [0.353553, 0.5]
    assert set(scores(app.query(Query(index).find(person))).values()) == {0.0}  # unset weights of unused spaces are 0
    same = NumberSpace(person.height, 100, 220, Mode.SIMILAR)
    index = Index(same)
    app = engine(spark, person, index, [dict(id="person1", height=175), dict(id="person2", height=180), dict(id="person3", height=99)])
    got = app.query(Query(index).find(person).similar(same, Param("h")), h=178).frame.collect()
    assert [r.id for r in got] == ["person2", "person1", "person3"] and got[2].score == 0
    assert round(got[0].score, 6) == round(math.cos(2 / 120 * math.pi / 2), 6)
    with pytest.raises(SchemaError):
        NumberSpace(person.height, 5, 5, Mode.SIMILAR)
    with pytest.raises(SchemaError):
        Query(Index(tall)).find(person).similar(tall, 3)
    beyond = NumberSpace(person.height, 100, 170, Mode.MAXIMUM, negative_filter=-1.0)
    index = Index(beyond)
    app = engine(spark, person, index, [dict(id="a", height=99), dict(id="b", height=300), dict(id="c")])
    assert scores(app.query(Query(index).find(person))) == {"a": -1.0, "b": 1.0, "c": 0.0}


class Post(Schema):
    id: IdField
    created_at: Timestamp | None


def test_recency(spark):
    post = Post()
    space = RecencySpace(post.created_at)
    index = Index(space)
    rows = [dict(id=f"post-{i}", created_at=NOW - d * DAY) for i, d in ((1, 2), (2, 4), (3, 8), (4, 10), (5, 60))] + [dict(id="post-6")]
    app = engine(spark, post, index, rows)
    assert scores(app.query(Query(index).find(post))) == {"post-1": 0.974928, "post-2": 0.900969, "post-3": 0.62349, "post-4": 0.433884, "post-5": 0.0, "post-6": 0.0}
    later = scores(app.query(Query(index).find(post).override_now(NOW + 60 * DAY)))
    assert set(later.values()) == {0.0}
    two = RecencySpace(post.created_at, period_time_list=[PeriodTime(timedelta(days=7), 1), PeriodTime(timedelta(days=1), 2)], negative_filter=-0.25)
    index = Index(two)
    app = engine(spark, post, index, rows)
    t = lambda d, p: ((p - 1 - d) / p, (p - 1) / p)
    expiry = NOW + DAY
    s7 = lambda d: math.cos(((NOW - (expiry - 7 * DAY)) - (NOW - d * DAY - (expiry - 7 * DAY))) / (7 * DAY) * math.pi / 2)
    got = scores(app.query(Query(index).find(post)))
    assert got["post-1"] == round(s7(2) / 5, 6) and got["post-3"] == got["post-5"] == -0.25 and got["post-6"] == 0 and t


class Custom(Schema):
    id: IdField
    sales: FloatList
    label: String | None


def test_custom_vectors_radius_and_lookalikes(spark):
    c = Custom()
    space = CustomSpace(c.sales, 3)
    index = Index(space, fields=[c.label])
    app = engine(spark, c, index, [dict(id="1", sales=[1, 0, 0], label="x"), dict(id="2", sales=[0, 0.8, 0.2]), dict(id="3", sales=[0.1, 0.1, 0.8])])
    for strategy in ("auto", "folded", "arrow"):
        for q, want in (([1, 0, 0], (1.0, 0.0, 0.123091)), ([0, 1, 0], (0.0, 0.970143, 0.123091)), ([0, 0, 1], (0.0, 0.242536, 0.984732))):
            got = scores(app.query(Query(index).find(c).similar(space, q), strategy=strategy))
            assert (got["1"], got["2"], got["3"]) == want
    assert set(scores(app.query(Query(index).find(c).similar(space, [0, 1, 0]).radius(0.1)))) == {"2"}
    like = app.query(Query(index).find(c).with_vector(c, "2").select(c.label, metadata=[space])).frame.collect()
    assert like[0].id == "2" and round(like[0].score, 6) == 1.0 and len(like[0].vector_parts[0]) == 3 and like[0].label is None
    both = scores(app.query(Query(index).find(c).with_vector(c, Param("who"), 1.0).similar(space, [1, 0, 0], Param("w", default=1.0)), who="2", w=-1.0))
    assert both["1"] < 0 < both["2"]
    with pytest.raises(SchemaError):
        app.query(Query(index).find(c).with_vector(c, "none"))


def brute(index, parts, stored):
    return sum(float(np.dot(a, b)) for a, b in zip(parts, stored))


def test_weights_of_several_spaces(spark):
    class Mixed(Schema):
        id: IdField
        body: String | None
        size: Integer | None
        v: FloatList | None

    m = Mixed()
    text, size, vec = TextSimilaritySpace(m.body), NumberSpace(m.size, 0, 10, Mode.SIMILAR, aggregation_mode=InputAggregation.AVERAGE), CustomSpace(m.v, 2)
    index = Index([text, size, vec], fields=[m.size])
    rows = [dict(id="a", body="red apple pie", size=3, v=[1, 0]), dict(id="b", body="green apple", size=8, v=[0, 1]), dict(id="c", body="", size=None, v=None)]
    app = engine(spark, m, index, rows)
    q = Query(index, weights={text: Param("tw", default=2.0), size: -0.5}).find(m).similar(text, "red apple").similar(size, 5).similar(size, 7, 3.0).include_metadata()
    got = {r.id: r for r in app.query(q).frame.collect()}
    e = text.embedder.query
    s1 = float(e("red apple pie") @ e("red apple"))
    s2 = math.cos((6.5 - 3) / 10 * math.pi / 2)
    assert got["a"].score == pytest.approx((2 * s1 - 0.5 * s2) / (math.hypot(2, 0.5) * math.sqrt(2)), abs=1e-9)
    assert got["c"].score == 0 and len(got["a"].partial_scores) == 3
    flipped = app.query(q, tw=0.0).frame.collect()
    assert flipped[-1].id != "c" and [r.id for r in flipped][0] == "c"
    scaled = {r.id: r.score for r in app.query(Query(index, weights={text: 4.0, size: -1.0}).find(m).similar(text, "red apple").similar(size, 5).similar(size, 7, 3.0)).frame.collect()}
    assert all(scaled[i] == pytest.approx(got[i].score, abs=1e-12) for i in scaled)
    look = {r.id: r.score for r in app.query(Query(index).find(m).with_vector(m, "a", {size: 0.0})).frame.collect()}
    assert look["a"] == pytest.approx(1.0)
    with pytest.raises(SchemaError):
        Query(index, weights={text: 1.0}).space_weights({text: 2.0})
    assert len(app.vectors(index, m, ["a"]).first().vector) == index.length
