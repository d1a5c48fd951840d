import pyarrow as pa
from pyspark.sql import types as T

from tesserine.llm import textops as X


def test_slices_cover_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "t": ["aa", None, "b" * 50, "", "cc", "d" * 9, "e"]})
    parts = list(X.sized_slices(batch, 1, 10))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(7))
    assert max(p.num_rows for p in parts) > 1 and any(p.num_rows == 1 for p in parts)
    assert list(X.sized_slices(batch.slice(0, 0), 1, 10)) == []


def test_map_keeps_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", "xy"), (None, None)], "doc_id string, text string").selectExpr("*", "1 as n")
    got = X.map_texts(df, lambda: lambda ts: [[len(t or "") for t in ts]], [("n", T.LongType())]).collect()
    assert {(r.doc_id, r.n) for r in got} == {("a", 2), (None, 0)}


def test_hash_share_bounds_large_tables_only(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    assert X.hash_share(df.limit(90), ["doc_id"], 50, 1).count() == 90
    n = X.hash_share(df, ["doc_id"], 1000, 1).count()
    assert 1600 < n < 2400 and n == X.hash_share(df, ["doc_id"], 1000, 1).count()


def test_checkpoint_outlives_its_plan(spark):
    cut = X.write_shared(spark.range(5).selectExpr("id * 2 as x"))
    assert sorted(r.x for r in cut.collect()) == [0, 2, 4, 6, 8] and "Range" not in cut._jdf.queryExecution().toString()


def test_hash_share_tells_rows_of_one_id_apart(spark):
    """Texts that share an id, and copies that outnumber all other rows."""
    df = spark.range(20000).selectExpr("3L as doc_id", "cast(if(id < 17000, 0, id) as string) as text")
    n = X.hash_share(df, ["doc_id", "text"], 500, 1).select("text").distinct().count()
    assert 800 < n < 1200
