"""Hard filters: every operator with and without missing values."""

import pytest

from tesserine import App, Boolean, CustomSpace, FloatList, IdField, Index, InMemorySource, Integer, Param, Query, Schema, SchemaError, String, StringList

ROWS = [
    dict(id="paragraph-1", body="The first thing Adam wrote.", author="Adam", length=300, tags=["old", "interesting"], is_active=False),
    dict(id="paragraph-2", body="The first thing Bob wrote.", author="Bob", length=500, tags=["fresh", "dull", "useful"], is_active=True),
    dict(id="paragraph-3", body="The second thing Adam wrote.", author="Adam", length=400, tags=["interesting", "funny", "fresh"], is_active=True),
    dict(id="paragraph-4"),
]


class Paragraph(Schema):
    id: IdField
    body: String | None
    author: String | None
    length: Integer | None
    tags: StringList | None
    is_active: Boolean | None
    v: FloatList | None


p = Paragraph()
space = CustomSpace(p.v, 2)
index = Index(space, fields=[p.author, p.body, p.length, p.tags, p.is_active])
CASES = {
    "==": (p.author == "Adam", "13"), "!=": (p.author != "Adam", "24"), "is": (p.is_active.is_(True), "23"), "is_not": (p.is_active.is_not_(False), "234"),
    "<=": (p.length <= 400, "13"), "<": (p.length < 400, "1"), ">": (p.length > 300, "23"), ">=": (p.length >= 400, "23"),
    "or": ((p.author == "Bob") | (p.length == 300), "12"), "or_": ((p.author == "Bob").or_(p.length == 400), "23"), "in": (p.author.in_(["Alice", "Adam", "Amon"]), "13"),
    "not_in": (p.author.not_in_(["Alice", "Adam", "Amon"]), "24"), "contains": (p.tags.contains(["fresh"]), "23"), "contains two": (p.tags.contains(["fresh", "interesting"]), "123"),
    "contains_all": (p.tags.contains_all(["fresh", "useful"]), "24"), "not_contains": (p.tags.not_contains(["fresh"]), "1"), "not_contains two": (p.tags.not_contains(["old", "dull"]), "3"),
    "scalar in": (p.author.in_("Bob"), "2"), "none in": (p.author.in_([None, "Bob"]), "24"), "id": (p.id.in_(["paragraph-2", "x"]), "2"),
}


@pytest.fixture(scope="module")
def app(spark):
    source = InMemorySource(p)
    out = App(spark, [source], [index], now=0)
    source.put(ROWS)
    return out


def ids(result):
    rows = result.frame.collect()
    assert all(r.score == 0 for r in rows)
    return "".join(r.id[-1] for r in rows)


@pytest.mark.parametrize("case", CASES)
def test_operators(app, case):
    where, want = CASES[case]
    assert ids(app.query(Query(index).find(p).filter(where))) == want


def test_stacked_filters_and_parameters(app):
    q = Query(index).find(p).filter(p.author == "Adam").filter(p.body == "The first thing Adam wrote.")
    assert ids(app.query(q)) == "1"
    q = Query(index).find(p).filter(p.author == Param("who")).limit(Param("n"))
    assert ids(app.query(q)) == "1234" and ids(app.query(q, who="Adam", n=1)) == "1"
    assert ids(app.query(q, who="Adam", n=0)) == "13"


def test_validation(app):
    with pytest.raises(SchemaError):
        app.query(Query(index).find(p).limit(Param("n")), wrong=1)
    with pytest.raises(SchemaError):
        Query(Index(space)).find(p).filter(p.author == "x")
    with pytest.raises(SchemaError):
        p.tags == ["x"]  # noqa: B015
    with pytest.raises(SchemaError):
        Query(index).find(p).radius(0.5).radius(0.4)
    with pytest.raises(SchemaError):
        app.query(Query(index).find(p).radius(1.5))
    with pytest.raises(SchemaError):
        app.query(Query(index).find(p).limit(Param("n", options=[1, 2])), n=3)
    with pytest.raises(SchemaError):
        Query(index).find(p).select("nothing")
    with pytest.raises(SchemaError):
        app.query(Query(index).find(p).similar(space, [1.0]))


def test_scalar_filters_reach_the_file(spark, tmp_path):
    from tesserine.plans.inspect import explain

    spark.createDataFrame([("a", "Adam", 3)], "id string, author string, length long").write.parquet(str(tmp_path / "t"))
    source = InMemorySource(p)
    app = App(spark, [source], [index], now=0)
    app.tables[p] = p.read(spark.read.parquet(str(tmp_path / "t")))
    plan = explain(app.query(Query(index).find(p).filter(p.length > 2).limit(5)))
    assert "GreaterThan(length,2)" in plan and "TakeOrderedAndProject" in plan
