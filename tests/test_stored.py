"""Embeddings, buckets and clusters that outlive a run."""

import random

import pyarrow.dataset as ds
from pyspark.sql import functions as F

from tesserine import App, Float, IdField, Index, Integer, Mode, NumberSpace, Schema, Source, String
from tesserine.functions.text import HashedEmbedder
from tesserine.sources.stored import BucketedRows, StoredEmbeddings, persist_clustered


def test_texts_are_embedded_once(spark, tmp_path):
    store = StoredEmbeddings(spark, f"{tmp_path}/m", HashedEmbedder(16))
    first = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c")], "id long, text string")
    assert store.add(first, "text") == 3 and store.add(first, "text") == 0
    more = first.union(spark.createDataFrame([(6, "d e"), (7, "c")], first.schema)).withColumn("key", F.lit("clash"))
    got = {r.id: r.vector for r in store.vectors(more, "text").collect()}
    plain = {r.id: r.v for r in more.select("id", HashedEmbedder(16).column(F.col("text")).alias("v")).collect()}
    assert got == plain and store.vectors(more, "text").columns == ["id", "text", "key", "vector"]
    assert store.add(more, "text") == 0
    spark.createDataFrame([(b"x", [1.0])], "key binary, vector array<double>").write.parquet(f"{tmp_path}/m/part=dead")
    (tmp_path / "m" / "part=dead" / "_SUCCESS").unlink()  # a run that did not end
    assert {r.id: r.vector for r in store.vectors(more, "text").collect()} == plain
    assert StoredEmbeddings(spark, f"{tmp_path}/none", HashedEmbedder(4)).vectors(first.limit(0), "text").count() == 0


class Thing(Schema):
    key: IdField
    size: Integer | None
    price: Float | None
    name: String | None


thing = Thing()
index = Index(NumberSpace(thing.price, 0, 10, Mode.MAXIMUM), fields=[thing.size, thing.name])


def test_buckets_merge_like_batches_and_leave_old_rows_in_place(spark):
    rng = random.Random(1)
    puts = [[{"key": str(rng.randint(0, 60)), "size": rng.choice([None, 1, 2, 3]), "price": rng.choice([None, rng.random()]), "name": rng.choice([None, "n", "m"])} for _ in range(25)] for _ in range(5)]
    tables = []
    for buckets in (None, 4):
        source = Source(thing)
        app = App(spark, [source], [index], buckets=buckets)
        for rows in puts:
            source.put(rows)
        tables.append(sorted(map(str, app.tables[thing].select("id", "size", "price", "name").collect())))
    assert tables[0] == tables[1]
    store = app.stores[thing]
    assert store.version == 5
    new = spark.createDataFrame([("1", 9, 1.0, "x")], "id string, size long, price double, name string").groupBy("id").agg(*[F.first(c).alias(c) for c in ("size", "price", "name")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.merged(new)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    old = plan[plan.rindex("Exchange hashpartitioning") :] if plan.index("Bucketed: true") < plan.index("Exchange hashpartitioning") else ""
    assert "Bucketed: true" in plan and old and "Bucketed: true" not in old  # the only exchanges are below the new rows
    store.drop()
    assert not any(t.name.startswith(store.name) for t in spark.catalog.listTables())
    fresh = BucketedRows(spark, "fresh_rows", 2)
    assert fresh.update(spark.createDataFrame([], "id string, x long")).count() == 0
    fresh.drop()


def test_filters_skip_row_groups_of_clustered_rows(spark, tmp_path):
    df = spark.range(40_000).selectExpr("cast(id as string) as id", "cast(id * 7919 % 1000 as int) as size", "cast(id * 104729 % 997 as double) as price", "concat('n', id * 31 % 50) as name").withColumn("size", F.when(F.col("size") != 7, F.col("size")))
    persist_clustered(df, f"{tmp_path}/z", ["size", "price", "name"], files=32)
    df.repartition(32).write.parquet(f"{tmp_path}/plain")

    def met(path: str, column: str, value) -> int:
        """Row groups whose bounds let a value in."""
        n = 0
        for part in ds.dataset(f"{tmp_path}/{path}").get_fragments():
            for group in part.row_groups:
                low_high = group.statistics.get(column)
                n += low_high is None or low_high["min"] <= value <= low_high["max"]
        return n

    for column, value in (("size", 500), ("price", 33.0), ("name", "n17")):
        assert met("z", column, value) <= 16 and met("plain", column, value) == 32
    stored = spark.read.parquet(f"{tmp_path}/z")
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect())) and stored.columns == df.columns
    assert stored.filter("size is null").count() == 40
