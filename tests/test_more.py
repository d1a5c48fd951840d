"""Chunks in the index, batches, look-ups by id, stores, converters and sums of vectors."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine import App, Blob, ByteEmbedder, CategoricalSimilaritySpace, CustomSpace, FloatList, IdField, ImageSpace, Index, Integer, Mode, NumberSpace, Param, Query, QueryUserConfig, Schema, SchemaError, Source, String, TextSimilaritySpace, chunk, chunk_text
from tesserine.functions.vectors import weighted_sum
from tesserine.operators.index import ORIGIN
from tesserine.plans.app import serializable
from tesserine.plans.natural import ModelFiller
from tesserine.sources.store import last_of, persist, restore


class Doc(Schema):
    key: IdField
    body: String | None
    n: Integer | None
    v: FloatList | None


doc = Doc()


def plain_chunks(text, size, overlap, seps=".!? "):
    """The rules of ``chunk_text`` over a list of characters' pieces, one separator after the other."""
    flat = re.sub("[ \t\n\r\f\v]+", " ", text).strip(" ")
    if len(flat) <= size:
        return [flat] if flat else []
    pieces = [flat]
    for sep in seps:
        pieces = [q for p in pieces for q in (re.findall(f"[^{re.escape(sep)}]*{re.escape(sep)} ?|[^{re.escape(sep)}]+", p) if len(p) > size else [p])]
    out, first = [], 0
    while True:
        last = first + 1
        while last < len(pieces) and sum(map(len, pieces[first : last + 1])) <= size:
            last += 1
        out.append("".join(pieces[first:last]).strip(" "))
        if last >= len(pieces):
            return [c for c in out if c]
        first = last
        while first > 0 and sum(map(len, pieces[first - 1 : last])) <= overlap and sum(map(len, pieces[first - 1 : last + 1])) <= size:
            first -= 1


def test_chunks_follow_the_plain_rules():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "c", " ", " ", ". ", ".", "! ", "?", "\n", "longer", "é"]) for _ in range(rng.randint(0, 120)))
        size = rng.randint(3, 60)
        overlap = rng.randint(0, size)
        assert chunk_text(text, size, overlap) == plain_chunks(text, size, overlap), (text, size, overlap)


def test_chunk_rows_and_origin_ids(spark):
    long = "Alpha beta gamma delta. " * 8 + "Omega rare word here. " * 2
    space, number = TextSimilaritySpace(chunk(doc.body, chunk_size=60, chunk_overlap=0)), NumberSpace(doc.n, 0, 10, Mode.SIMILAR)
    index = Index([space, number], fields=[doc.n])
    for flag in (False, True):
        source = Source(doc)
        app = App(spark, [source], [index], return_origin_id=flag)
        source.put([{"key": "a", "body": long, "n": 3}, {"key": "b", "body": "short", "n": 4}, {"key": "c"}])
        rows = app.query(Query(index).find(doc).similar(space, "omega rare word here").select(doc.n)).frame.collect()
        ids = [r.id for r in rows]
        assert len(rows) == 3 + len(chunk_text(long, 60, 0)) + 1
        assert ids[0] == ("a" if flag else f"a#{len(chunk_text(long, 60, 0)) - 1}") and rows[0].n is None
        assert flag == (ids.count("a") > 1)
        assert {r.id for r in app.query(Query(index).find(doc).filter(doc.n == 3)).frame.collect()} == {"a"}
    table = app.rows(index, doc)
    assert {r[ORIGIN] for r in table.filter(f"{ORIGIN} is not null").collect()} == {"a", "b"}
    for wrong in (lambda: chunk(doc.n), lambda: chunk(doc.body, chunk_size=0), lambda: chunk(doc.body, chunk_size=10, chunk_overlap=11)):
        with pytest.raises(SchemaError):
            wrong()


def test_batches_merge_in_one_shuffle_and_cut_their_lineage(spark):
    space = NumberSpace(doc.n, 0, 100, Mode.SIMILAR)
    index, source, seen = Index(space), Source(doc), []
    app = App(spark, [source], [index], queue=lambda name, row: seen.append((name, row["key"])))
    for i in range(20):
        source.put([{"key": "a", "n": i}, {"key": f"k{i}", "body": str(i)}])
        plan = app.tables[doc]._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Aggregate") <= 1 and len(app.batches[doc]) <= 8
    got = {r.id: (r.n, r.body) for r in app.tables[doc].collect()}
    assert len(got) == 21 and got["a"] == (19, None) and got["k7"] == (None, "7")
    assert len(seen) == 40 and seen[0] == ("Doc", "a")


def test_repeated_rows_without_an_order_give_one_result(spark):
    rows = [("a", i, None if i % 2 else f"t{i}") for i in range(50)]
    found = {tuple(last_of(spark.createDataFrame(rows, "id string, n int, body string").repartition(k)).collect()[0]) for k in (1, 3, 7)}
    assert len(found) == 1
    assert last_of(spark.createDataFrame(rows, "id string, n int, body string"), order="n").collect()[0] == ("a", 49, "t48")


def test_look_ups_by_id_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id as key", "cast(id as string) as body", "cast(id % 50 as int) as n").write.parquet(path)
    space = NumberSpace(doc.n, 0, 100, Mode.SIMILAR)
    index, source = Index(space), Source(doc, unique=True)
    app = App(spark, [source], [index])
    source.put(spark.read.parquet(path))
    frame = app.query(Query(index).find(doc).filter(doc.key.in_(["7", "07", "x"]))).frame
    assert [r.id for r in frame.collect()] == ["7"]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(EqualTo\(key,7\)|In\(key, \[7\]\))", plan), plan
    assert app.query(Query(index).find(doc).filter(doc.key == "none")).frame.count() == 0
    assert [r.id for r in app.vectors(index, doc, ["12"]).collect()] == ["12"]
    assert app.entities(doc, [doc.n > 47], [doc.body]).count() == 40


def test_half_floats_and_converters(spark, tmp_path):
    df = spark.createDataFrame([("a", [0.1, -2.5, 1000.0], b"xyz"), ("b", None, None)], "id string, v array<double>, blob binary")
    persist(df, str(tmp_path / "h"), half=True)
    assert dict(spark.read.parquet(str(tmp_path / "h")).dtypes)["v"] == "array<smallint>"
    got = {r.id: r.v for r in restore(spark, str(tmp_path / "h")).collect()}
    assert np.allclose(got["a"], [0.1, -2.5, 1000.0], rtol=1e-3) and got["b"] is None
    rows = {r.id: r for r in df.transform(serializable).collect()}
    assert rows["a"].blob == "eHl6" and dict(df.transform(serializable).dtypes)["v"] == "array<float>"


def test_sums_of_vectors_keep_their_filters():
    v, mask = weighted_sum([(np.array([1.0, 0, -5]), 2.0), (np.array([3.0, 0, -5]), -1.0)], [np.array([False, False, True])] * 2)
    assert v.tolist() == [-1, 0, -5] and mask.tolist() == [False, False, True]
    one, mask = weighted_sum([(np.array([1.0, -5]), 3.0), (np.array([9.0, 9]), 0.0)], [np.array([False, True]), np.array([False, False])])
    assert one.tolist() == [3, -5] and mask.tolist() == [False, True]
    mixed, mask = weighted_sum([(np.array([1.0, -5]), 1.0), (np.array([1.0, 2]), 1.0)], [np.array([False, True]), np.array([False, False])])
    assert mixed.tolist() == [2, 2] and not mask.any()
    with pytest.raises(SchemaError):
        weighted_sum([(np.array([-5.0]), 1.0), (np.array([-4.0]), 1.0)], [np.array([True])] * 2)


def test_names_of_values_and_user_config(spark):
    space = NumberSpace(doc.n, 0, 100, Mode.SIMILAR, salt="s")
    index = Index([space, CustomSpace(doc.v, 2)], fields=[doc.n, doc.body])
    source = Source(doc)
    app = App(spark, [source], [index])
    source.put([{"key": "a", "n": 1, "v": [1.0, 0.0]}])
    query = Query(index).find(doc).filter(doc.n > 0).filter(doc.n > -5).filter(doc.body != Param("not_this")).similar(space, 3)
    result = app.query(query.replace_user_config(QueryUserConfig(with_metadata=True)), not_this="x")
    assert len(result.frame.collect()[0].partial_scores) == 2
    names = result.metadata["search_params"]
    assert names["hard_filter_n_be_greater_than_param__"] == 0 and names["hard_filter_n_be_greater_than_param__1__"] == -5 and names["not_this"] == "x"
    assert space.name == "NumberSpace(n, s)"


def test_labels_and_bytes(spark):
    class Page(Schema):
        key: IdField
        kind: String | None
        data: Blob | None

    page = Page()
    kinds, image = CategoricalSimilaritySpace(page.kind, ["a", "bb"]), ImageSpace(page.data, ByteEmbedder())
    index, source = Index([kinds, image]), Source(page)
    app = App(spark, [source], [index])
    source.put([{"key": "1", "kind": "a", "data": b"\x00\x01\xff"}, {"key": "2", "kind": "zz", "data": b""}, {"key": "3"}])
    rows = {r.id: r for r in app.rows(index, page).select("id", kinds.labels(F.col("__raw_0")).alias("labels"), "__raw_1").collect()}
    assert rows["1"].labels == ["a"] and rows["2"].labels == ["bb_"] and rows["3"].labels is None
    assert np.allclose(rows["1"]["__raw_1"], [2 / 5**0.5, *[0] * 14, 1 / 5**0.5]) and not any(rows["3"]["__raw_1"])


def test_a_model_fills_parameters_and_wrong_answers_go_back(spark):
    params = [Param("brand", "the maker", options=("A", "B")), Param("price_weight"), Param("most")]
    asked, answers = [], iter(["nothing", '{"brand": "C"}', 'Sure: {"brand": "B", "price_weight": -1, "most": null}'])
    filler = ModelFiller(lambda prompt: asked.append(prompt) or next(answers), "Be brief.")
    assert filler.fill("cheap ones by B", params) == {"brand": "B", "price_weight": -1}
    assert "the maker" in asked[0] and '["A", "B"]' in asked[0] and "[-1, 0, 1]" in asked[0] and "C" in asked[2] and "no JSON" in asked[1]
    for wrong in ('{"price_weight": 2}', '{"other": 1}', "{"):
        with pytest.raises(SchemaError):
            ModelFiller(lambda prompt, w=wrong: w).fill("x", params)
    space = NumberSpace(doc.n, 0, 10, Mode.MAXIMUM)
    index, source = Index(space, fields=[doc.n]), Source(doc)
    app = App(spark, [source], [index])
    source.put([{"key": str(i), "n": i} for i in range(9)])
    query = Query(index).find(doc).filter(doc.n <= Param("most")).limit(Param("limit")).with_natural_query("the two best up to five", ModelFiller(lambda prompt: '{"most": 5, "limit": 2}'))
    assert [r.id for r in app.query(query).frame.collect()] == ["5", "4"]
