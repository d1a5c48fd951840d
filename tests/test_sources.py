"""Sources, stores, text functions, batch search, natural language and inspection."""

import datetime
import decimal

import numpy as np
import pandas as pd
import pytest

from tesserine import App, CustomSpace, DataFormat, DataLoaderConfig, FloatList, IdField, Index, InMemorySource, Integer, Param, Query, RecencySpace, Schema, SchemaError, Source, String, StringList, Timestamp, batch_top_k, chunk_text, chunked
from tesserine.plans.inspect import describe, recency_curve, vector_bytes
from tesserine.plans.natural import RuleFiller
from tesserine.sources import readers, store


class Doc(Schema):
    id: IdField
    body: String | None
    at: Timestamp | None
    n: Integer | None
    tags: StringList | None
    v: FloatList | None


doc = Doc()


@pytest.mark.parametrize("fmt", [DataFormat.CSV, DataFormat.JSON, DataFormat.PARQUET, DataFormat.ORC, DataFormat.XML, DataFormat.FWF])
def test_formats(spark, tmp_path, fmt):
    path = str(tmp_path / "data")
    df = spark.createDataFrame([(1, "aa", 5), (2, "bb", None)], "id int, body string, n int")
    widths = ()
    if fmt is DataFormat.FWF:
        spark.createDataFrame([("1   aa  5   ",), ("2   bb      ",)], "value string").write.text(path)
        widths = (("id", 1, 4), ("body", 5, 4), ("n", 9, 4))
    elif fmt is DataFormat.XML:
        df.write.format("xml").option("rowTag", "row").save(path)
    else:
        df.write.format(fmt.value).option("header", "true").save(path)
    raw = readers.load(spark, DataLoaderConfig(path, fmt, widths=widths))
    if fmt is DataFormat.FWF:
        raw = raw.selectExpr("id", "body", "nullif(n, '') as n")
    rows = sorted(doc.read(raw).select("id", "body", "n").collect())
    assert [tuple(r) for r in rows] == [("1", "aa", 5), ("2", "bb", None)]


def test_mapping_and_casts(spark):
    df = spark.createDataFrame([(decimal.Decimal("7"), {"deep": {"text": "x"}}, datetime.date(2024, 8, 10), "one")], "key decimal(5,0), a struct<deep: struct<text: string>>, day date, tags string")
    row = doc.read(df, {doc.id: "key", "body": "a.deep.text", "at": "day"}).first()
    assert (row.id, row.body, row.at, row.tags, row.v) == ("7", "x", 1723248000, ["one"], None)
    rows = readers.from_rows(spark, doc, [{"id": 3, "inner": {"b": "y"}, "tags": ["p", "q"]}], {"body": "inner.b"}).collect()
    assert (rows[0].id, rows[0].body, rows[0].tags) == ("3", "y", ["p", "q"])
    back = readers.to_json(doc.read(df, {doc.id: "key", "body": "a.deep.text", "at": "day"}), doc, {"body": "a.b"}).first().value
    assert '"a":{"b":"x"}' in back
    with pytest.raises(SchemaError):
        doc.read(df, {"nothing": "key"})
    with pytest.raises(SchemaError):
        doc.read(df.drop("key"))
    with pytest.raises(Exception, match="without an id"):
        doc.read(spark.createDataFrame([(" ",)], "id string")).collect()


def test_upsert_persist_restore(spark, tmp_path):
    source = InMemorySource(doc)
    app = App(spark, [source], [Index(CustomSpace(doc.v, 2))], now=0)
    source.put([dict(id="1", body="a", n=1), dict(id="2", body="b")])
    source.put([dict(id="1", body="c"), dict(id="1", n=9)])
    source.put(pd.DataFrame({"id": ["3"], "body": ["d"]}))
    rows = {r.id: (r.body, r.n) for r in app.tables[doc].collect()}
    assert rows == {"1": ("c", 9), "2": ("b", None), "3": ("d", None)}
    vectors = spark.createDataFrame([("1", [0.5, 0.25])], "id string, v array<double>")
    store.persist(vectors, str(tmp_path / "t"), half=True)
    assert store.restore(spark, str(tmp_path / "t")).first().v == [0.5, 0.25]
    with pytest.raises(SchemaError):
        Source(doc).put([dict(id="1")])


def test_tee(spark, tmp_path):
    inbox, seen, kept = str(tmp_path / "in"), [], []
    spark.createDataFrame([("1", "x")], "id string, body string").write.json(inbox)
    stream = readers.load_stream(spark, DataLoaderConfig(inbox, DataFormat.JSON), spark.read.json(inbox).schema)
    query = store.tee(stream, lambda df, n: kept.extend(df.collect()), lambda df: seen.extend(df.toJSON().collect()), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert len(kept) == 1 and "x" in seen[0]


def test_chunks(spark):
    assert chunk_text(None) == [] and chunk_text("short") == ["short"]
    text = "One sentence here. Another one follows! " * 20
    chunks = chunk_text(text, size=100, overlap=30)
    assert all(len(c) <= 100 for c in chunks) and len(chunks) > 8
    assert all(b.split(". ")[0].split("! ")[0] in a for a, b in zip(chunks, chunks[1:]))
    assert chunk_text("aaa|bbb|ccc", size=4, overlap=0, removed=["|"], kept=[]) == ["aaa", "bbb", "ccc"]
    assert chunk_text("x" * 600) == ["x" * 600]
    rows = chunked(spark.createDataFrame([("a", text), ("b", None)], "id string, body string"), "id", "body", size=100, overlap=30).orderBy("position").collect()
    assert [r.chunk for r in rows] == chunks and rows[1].id == "a#1" and rows[1].origin_id == "a"


def test_batch_search_equals_brute_force(spark, monkeypatch):
    import tesserine.plans.query as Q

    monkeypatch.setattr(Q, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)] + [("none", None)], "id string, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(20)], "query_id int, query array<double>")
    got = {}
    for r in batch_top_k(rows, queries, 8, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for i in range(20):
        want = sorted(range(300), key=lambda j: (-round(float(v[j] @ v[i]), 9), str(j)))[:5]
        assert [got[i][k] for k in range(1, 6)] == [str(j) for j in want]


def test_batch_search_keeps_vectors_off_the_driver(spark, monkeypatch):
    import tesserine.plans.query as Q
    from pyspark.sql import functions as F

    def refuse(*_):
        raise AssertionError("vectors sent to the driver")

    monkeypatch.setattr(Q, "QUERY_BLOCK", 7)
    monkeypatch.setattr(Q, "LEAST_ROWS", 50, raising=False)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(200, 4)), 1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    queries = spark.createDataFrame([(None if i == 3 else i, None if i == 5 else v[i].tolist()) for i in range(30)], "query_id long, query array<double>").mapInArrow(counted, "query_id long, query array<double>")
    monkeypatch.setattr(type(rows), "toArrow", refuse)
    monkeypatch.setattr(spark.sparkContext, "broadcast", refuse)
    got = batch_top_k(rows, queries, 4, 3).select("query_id", "rank", F.col("id")).collect()
    assert seen.value == 30  # what lies behind the queries runs once
    have = {(r.query_id, r["rank"]): r.id for r in got}
    assert len(got) == len(have) == 29 * 3
    for i in set(range(30)) - {5}:
        want = sorted(range(200), key=lambda j: (-round(float(v[j] @ v[i]), 9), str(j)))[:3]
        assert [have[None if i == 3 else i, n] for n in (1, 2, 3)] == [str(j) for j in want]


def test_natural_language_and_inspection(spark):
    space = CustomSpace(doc.v, 2)
    index = Index([space, RecencySpace(doc.at)], fields=[doc.body])
    source = InMemorySource(doc)
    app = App(spark, [source], [index], now=1723248000)
    source.put([dict(id="1", body="red", v=[1, 0], at=1723248000), dict(id="2", body="blue", v=[0, 1], at=0)])
    q = Query(index, weights={space: Param("vector_weight")}).find(doc).filter(doc.body == Param("colour", options=["red", "blue"])).limit(Param("limit")).with_natural_query(Param("text"), RuleFiller())
    rows = app.query(q, text="top 1 blue things").frame.collect()
    assert [r.id for r in rows] == ["2"]
    assert app.query(q, text="top 1 blue things", colour="red").frame.first().id == "1"
    result = app.query(Query(index, weights={index.spaces[1]: 1.0}).find(doc).similar(space, [1, 0]).select_all())
    assert list(result.to_pandas(format_dates=("at",)).columns)[-1] == "similarity_score" and result.metadata["schema_name"] == "Doc" and len(result.metadata["search_vector"]) == index.length
    assert '"score"' in result.to_json().first().value
    curve = recency_curve(spark, index.spaces[1], 1723248000, 50).orderBy("created_at").collect()
    assert curve[0].score == 0 and curve[-1].score > 0.99 and len(curve) == 50
    assert [d["offset"] for d in describe(index)] == [0, 2]
    assert {r.space: r.bytes for r in vector_bytes(app.rows(index, doc), index).collect()}["CustomSpace(v)"] == 32
