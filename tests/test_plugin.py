"""Plugged sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tesserine import SchemaError
from tesserine.sources.plugin import ArrowFiles, Condition, Plugged, plugged

FILES = "tesserine.sources.plugin:ArrowFiles"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plug") / "t")
    spark.range(0, 1000, 1, 4).selectExpr("id", "id % 7 as k", "if(id % 5 = 0, null, concat('t', id)) as name").write.parquet(path)
    return path


def test_rows_and_conditions(spark, table):
    plain = spark.read.parquet(table)
    df = plugged(spark, FILES, path=table)
    assert df.schema.simpleString() == plain.schema.simpleString() and df.count() == 1000
    assert sorted(df.filter("name = 't7' or k = 1").collect(), key=str) == sorted(plain.filter("name = 't7' or k = 1").collect(), key=str)
    for conditions, where in (
        ([Condition("k", "==", 3)], "k = 3"), ([Condition("k", "in", [1, 2]), Condition("id", ">", 900)], "k in (1, 2) and id > 900"), ([Condition("name", "is null")], "name is null"),
        ([Condition("name", "is not null"), Condition("id", "<=", 40), Condition("id", ">=", 3)], "name is not null and id between 3 and 40"), ([Condition("id", "<", 0)], "false"),
    ):
        assert sorted(plugged(spark, FILES, conditions, path=table).collect(), key=str) == sorted(plain.filter(where).collect(), key=str), where
    with pytest.raises(SchemaError, match="no condition"):
        plugged(spark, FILES, [Condition("k", "like", "x")], path=table)


def test_parts_are_row_groups_that_may_hold_rows(table):
    parts = lambda *conditions: ArrowFiles({"path": table}, list(conditions)).parts()
    assert len(parts()) == 4 and len(parts(Condition("id", ">", 800))) == 1
    assert parts(Condition("id", "==", -1)) == [] and len(parts(Condition("id", "in", [1, 999]), Condition("name", "is not null"))) == 2
    files = ArrowFiles({"path": table}, [Condition("id", ">", 800)])
    rows = [r for p in files.parts() for b in files.read(p) for r in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(801, 1000))


def test_a_sink_gets_every_row_once(spark, table, tmp_path):
    spark.dataSource.register(Plugged)
    stream = spark.readStream.schema("id long, k long, name string").option("maxFilesPerTrigger", 2).parquet(table)
    out = f"{tmp_path}/sink"
    query = stream.filter("k < 3").writeStream.format("plugged").option("class", "tesserine.sources.plugin:JsonFolder").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    lists = sorted((tmp_path / "sink").glob("batch-*.list"))
    names = [n for f in lists for n in f.read_text().split("\n") if n]
    rows = [json.loads(line) for n in names for line in (tmp_path / "sink" / n).read_text().splitlines()]
    assert len(lists) >= 2 and sorted(r["id"] for r in rows) == [i for i in range(1000) if i % 7 < 3]


def test_a_source_needs_a_name(spark, table):
    with pytest.raises(Exception, match="module:Class"):
        plugged(spark, "no name", path=table).select(F.count("*")).collect()
