"""Search by cells: equal to the plain scan, with few cells read."""

from datetime import timedelta

import numpy as np
import pytest

from tesserine import App, CustomSpace, FloatList, IdField, Index, Integer, PeriodTime, Query, RecencySpace, Schema, SchemaError, Source, Timestamp
from tesserine.functions.clusters import k_means, nearest, sample_matrix
from tesserine.operators.cells import CellIndex
from tesserine.plans.query import batch_top_k


class Point(Schema):
    key: IdField
    v: FloatList | None
    kind: Integer


point = Point()
space = CustomSpace(point.v, 8)
index = Index(space, fields=[point.kind])


def points(n=1500, seed=3):
    """Clustered directions, many equal rows, a null and a zero vector."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(30, 8))
    m = heads[rng.integers(0, 30, n)] + rng.normal(size=(n, 8)) * 0.15
    m[n // 3 : 2 * n // 3] = heads[0]
    rows = [{"key": f"p{i}", "v": v.tolist(), "kind": i % 7} for i, v in enumerate(m)]
    rows[5]["v"], rows[6]["v"] = None, [0.0] * 8
    return rows, heads


@pytest.fixture(scope="module")
def app(spark):
    rows, _ = points()
    source = Source(point, unique=True)
    made = App(spark, [source], [index], now=1000)
    source.put(spark.createDataFrame([tuple(r.values()) for r in rows], "key string, v array<double>, kind int").coalesce(2))
    return made


def queries():
    heads = points()[1]
    for seed, probe in enumerate([heads[0], -heads[4]]):
        q = Query(index).find(point).similar(space, probe.tolist())
        yield from (q.limit(1), q.limit(40).filter(point.kind == seed), q.limit(700), q.radius(0.05), q.radius(0.4).limit(15), q.filter(point.kind == 99).limit(3))


def test_equals_the_plain_scan(app):
    plain = [[(r.id, round(r.score, 9)) for r in app.query(q).frame.collect()] for q in queries()]
    cells = app.deal(index, point)
    assert [[(r.id, round(r.score, 9)) for r in app.query(q).frame.collect()] for q in queries()] == plain
    again = CellIndex.open(app.spark, index, cells.path)
    plan = next(queries()).bind({}, lambda *_: {}, 1000)
    assert np.array_equal(again.centres, cells.centres) and again.frame(plan).collect() == cells.frame(plan).collect()
    app.cells.clear()


def test_few_cells_are_read(app):
    cells = app.deal(index, point)
    assert int(cells.cells["n"].sum()) == 1500 and -1 in cells.cells["cell"]
    heads = points()[1]
    near = Query(index).find(point).similar(space, heads[7].tolist())
    for q in (near.limit(10), near.radius(0.1)):
        plan = q.bind({}, lambda *_: {}, 1000)
        assert 0 < cells.share_read(plan) < 0.35
        explained = cells.frame(plan)._jdf.queryExecution().toString()
        assert "PartitionFilters: [" in explained and "PushedFilters" in explained and "angle" in explained
    app.ingest(app.sources[0], {"key": "new", "v": heads[7].tolist(), "kind": 1})
    assert not app.cells and app.query(near.limit(1)).frame.first().id == "new"


def test_many_queries_equal_the_plain_way(app, monkeypatch):
    """Hot cells are split, queries without a vector left out, and most pairs of a query and a cell never meet."""
    import tesserine.operators.cells as K

    monkeypatch.setattr(K, "ROWS_MET", 150)
    monkeypatch.setattr(K, "QUERIES_MET", 5)
    cells = app.deal(index, point)
    rows = app.spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(points()[0] and points()[1][:12])] + [("none", None), ("zero", [0.0] * 8)], "query_id string, query array<double>")
    vectors = index.with_vectors(app.rows(index, point), None).select("id", "vector")
    for k in (1, 30):
        got = sorted((r.query_id, r.rank, r.id, r.score) for r in cells.batch(rows, k).collect())
        assert got == sorted((r.query_id, r.rank, r.id, r.score) for r in batch_top_k(vectors, rows, 8, k).collect())
    asked = rows.filter("query is not null and query_id <> 'zero'").select(rows["query_id"].alias("q"), rows["query"].alias("v"))
    near = batch_top_k(vectors, rows, 8, 5).filter("rank = 5").selectExpr("query_id as q", "score as least")
    met = cells._sent(asked, 5).count() + cells._sent(asked.join(near, "q", "left"), 5, True).count()
    assert met < 0.35 * 12 * len(cells.cells["n"])
    app.cells.clear()


def test_empty_tables_and_clocks(spark):
    source = Source(point, unique=True)
    app = App(spark, [source], [index], now=1)
    source.put(spark.createDataFrame([], "key string, v array<double>, kind int"))
    app.deal(index, point)
    assert app.query(Query(index).find(point).similar(space, [1.0] * 8).limit(3)).frame.count() == 0

    class Dated(Schema):
        key: IdField
        at: Timestamp

    dated = Dated()
    recent = RecencySpace(dated.at, period_time_list=[PeriodTime(timedelta(days=3))])
    by_time = Index(recent)
    source = Source(dated)
    app = App(spark, [source], [by_time], now=500_000)
    source.put([{"key": str(i), "at": 1000 * i} for i in range(400)])
    q = Query(by_time).find(dated).limit(20)
    plain = app.query(q).frame.collect()
    app.deal(by_time, dated)
    assert app.query(q).frame.collect() == plain
    with pytest.raises(SchemaError, match="time of their making"):
        app.query(q.override_now(400_000)).frame.collect()


def test_bounds_hold_for_every_row(app):
    cells = app.deal(index, point)
    rows = index.with_vectors(app.rows(index, point), None).select("id", "vector").collect()
    own = {r.id: r.cell for r in app.spark.read.parquet(f"{cells.path}/rows").select("id", "cell").collect()}
    at = {c: i for i, c in enumerate(cells.cells["cell"].tolist())}
    rng = np.random.default_rng(9)
    for q in rng.normal(size=(20, 8)):
        bound = cells.bounds(q)
        assert all(np.dot(q, r.vector) <= bound[at[own[r.id]]] for r in rows)
    app.cells.clear()


def test_k_means_and_its_sample(spark):
    rng = np.random.default_rng(1)
    heads = np.eye(6)[:4] * 3
    m = np.repeat(heads, 50, axis=0) + rng.normal(size=(200, 6)) * 0.05
    for spherical in (True, False):
        c = k_means(m, 4, spherical)
        assert len({tuple(x) for x in nearest(m, c, spherical).reshape(4, 50)[:, :1].tolist()}) == 4
        assert np.array_equal(c, k_means(m, 4, spherical))
        assert not spherical or np.allclose(np.linalg.norm(c, axis=1), 1)
    assert len(k_means(np.ones((9, 2)), 5)) == 1
    df = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(3000)] + [("x", None)], "id string, vector array<double>")
    import tesserine.functions.clusters as K

    assert len(sample_matrix(df, 2)) == 3000
    old, K.SAMPLE_ROWS = K.SAMPLE_ROWS, 100
    try:
        assert len(sample_matrix(df, 2)) == 100
        one_id = df.selectExpr("'same' as id", "vector")  # an id that all rows share
        assert len(sample_matrix(one_id, 2)) == 100
    finally:
        K.SAMPLE_ROWS = old
