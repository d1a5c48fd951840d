"""More registered queries: sources and stores, event effects of other spaces, chunks, look-ups, norms."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import vectors as V
from tesserine.functions.images import ByteEmbedder
from tesserine.operators.index import Effect, Index
from tesserine.operators.spaces import CategoricalSimilaritySpace, Context, CustomSpace, ImageSpace, InputAggregation, Mode, NumberSpace, PeriodTime, RecencySpace, TextSimilaritySpace, chunk
from tesserine.plans import catalog as C
from tesserine.plans.app import App, Source
from tesserine.plans.inspect import vector_bytes
from tesserine.plans.natural import RuleFiller
from tesserine.plans.query import Param, Query
from tesserine.schema import Blob, Boolean, CreatedAtField, EventSchema, Float, IdField, Integer, Schema, SchemaReference, String
from tesserine.sources.readers import DataFormat, DataLoaderConfig, decode_blob
from tesserine.sources.store import kept_for_session, persist, restore

QUERIES, ORACLES, register = C.QUERIES, C.ORACLES, C.register


class Account(Schema):
    key: IdField
    balance: Float
    rich: Boolean | None
    segment: String


class Member(Schema):
    key: IdField
    level: Float | None


class Thing(Schema):
    key: IdField
    label: Integer
    kind: String


class Visit(EventSchema):
    key: IdField
    created_at: CreatedAtField
    member: SchemaReference[Member]
    thing: SchemaReference[Thing]
    what: String


class Page(Schema):
    key: IdField
    body: Blob


account, member, thing, visit, page = Account(), Member(), Thing(), Visit(), Page()
C.TABLES |= {
    account: lambda s, d: C._read(s, d, "customer").selectExpr("c_custkey as key", "c_acctbal as balance", "if(c_custkey % 7 = 0, null, c_acctbal > 5000) as rich", "c_mktsegment as segment"),
    thing: lambda s, d: C._read(s, d, "embeddings").selectExpr("vec_id as key", "label", "concat('k', label) as kind"),
    page: lambda s, d: C._read(s, d, "pages").selectExpr("page_id as key", "to_binary(html, 'utf-8') as body"),
}

# conditions on truth values, the clock, several inputs ------------------------
_balance = NumberSpace(account.balance, -1000, 10000, Mode.MAXIMUM)
_index = Index(_balance, fields=[account.rich, account.segment])
_ACCOUNT = "(SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS balance, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal > 5000 END AS rich, c_mktsegment AS segment FROM customer)"
_rising = f"sin({C._angle('balance', -1000.0, 10000.0)})"
register("filter_is", _index, Query(_index).find(account).filter(account.rich.is_(True)), C._top(_rising, _ACCOUNT, where="WHERE rich"))
register("filter_is_not", _index, Query(_index).find(account).filter(account.rich.is_not_(True)), C._top(_rising, _ACCOUNT, where="WHERE rich IS DISTINCT FROM true"))

_recent = RecencySpace(C.order.placed, period_time_list=[PeriodTime(timedelta(days=300))])
_index = Index(_recent)
_earlier = C.NOW - 400 * 86_400
_end = _earlier + 86_400
register("override_now", _index, Query(_index).find(C.order).override_now(Param("as_of")), C._top(f"CASE WHEN placed BETWEEN {_end - 300 * 86_400} AND {_end} THEN cos(({_earlier} - placed) / {300 * 86_400.0} * {C._HALF}) ELSE 0 END", C.ORDER_SQL), as_of=_earlier)

for _how, _at in ((InputAggregation.MINIMUM, 10.0), (InputAggregation.MAXIMUM, 30.0), (InputAggregation.AVERAGE, 25.0)):
    _size = NumberSpace(C.part.size, 1, 40, Mode.SIMILAR, aggregation_mode=_how)
    _index = Index(_size)
    register(f"inputs_{_how.value}", _index, Query(_index).find(C.part).similar(_size, 10, 1.0).similar(_size, 30, 3.0), C._top(f"CASE WHEN size IS NULL OR size > 40 THEN 0 ELSE cos({C._angle('size', 1.0, 40.0)} - {C._angle(str(_at), 1.0, 40.0)}) END", C.PART_SQL))

_price, _brand = NumberSpace(C.part.price, 900, 1000, Mode.MINIMUM), CategoricalSimilaritySpace(C.part.brand, C.BRANDS)
_index = Index([_price, _brand], fields=[C.part.type, C.part.size])
_natural = (
    Query(_index, weights={_price: Param("price_weight", default=1.0), _brand: 1.0}).find(C.part).similar(_brand, Param("brand", options=tuple(C.BRANDS)))
    .filter(C.part.size <= Param("size")).limit(Param("limit")).with_natural_query(Param("ask"), RuleFiller())
)
register("natural_query", _index, _natural, C._top(f"({C._marks('Brand#13')} - cos({C._angle('price', 900.0, 1000.0)})) / (sqrt(2.0) * sqrt(2.0))", C.PART_SQL, 40, "WHERE size <= 20"), ask="top 40 of brand#13, avoid price, size up to 20")

# chunks ----------------------------------------------------------------------
_text = TextSimilaritySpace(chunk(C.document.text, chunk_size=300, chunk_overlap=40))
_index = Index(_text)
_ABOUT = "the and of worthless stories"


def chunk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents and chunks of documents, chunks under their document's id."""
    source = Source(C.document, unique=True)
    app = App(spark, [source], [_index], now=C.NOW, return_origin_id=True)
    source.put(C.TABLES[C.document](spark, sf_dir))
    found = app.query(Query(_index).find(C.document).similar(_text, _ABOUT).radius(0.6137)).frame
    return found.groupBy("id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("score"))


QUERIES["chunk_topk"] = chunk_topk
ORACLES["chunk_topk"] = f"""
WITH c AS ({C._chunks_sql(300, 40, '(SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents)')}),
  r AS (SELECT id, pos, chunk AS text FROM c WHERE chunk <> '' UNION ALL SELECT CAST(doc_id AS VARCHAR), -1, text FROM documents),
  w AS (SELECT id, pos, unnest({C._HASHED.format('text')}) AS w FROM r),
  h AS (SELECT id, pos, ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS b, CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT < 8 THEN 1.0 ELSE -1.0 END AS s FROM w),
  n AS (SELECT id, pos, b, sum(s) AS n FROM h GROUP BY ALL),
  q AS (SELECT ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS b, sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT < 8 THEN 1.0 ELSE -1.0 END) AS m FROM (SELECT unnest({C._HASHED.format(f"'{_ABOUT}'")}) AS w) GROUP BY b),
  d AS (SELECT n.id, n.pos, coalesce(sum(n * m), 0) / nullif(sqrt(sum(n * n)), 0) / (SELECT sqrt(sum(m * m)) FROM q) AS s FROM n LEFT JOIN q USING (b) GROUP BY n.id, n.pos)
SELECT id, count(*) AS hits, round(max(s), 6) AS score FROM d WHERE s >= 0.3863 GROUP BY id"""


# events on numbers and categories, last events, rows that only events fill --------
def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C._interactions(spark, sf_dir).withColumnsRenamed({"user": "member", "item": "thing", "kind": "what"})


def _visited(spark: SparkSession, sf_dir: str, index: Index, query: Query, distinct_events: bool = False) -> DataFrame:
    sources = [Source(s, unique=True) for s in (member, thing, visit)]
    app = App(spark, sources, [index], now=C.EVENTS_NOW, distinct_events=distinct_events)
    visits = _visits(spark, sf_dir)
    members = visits.select(F.col("member").alias("key")).distinct().withColumn("level", F.when(F.col("key") % 3 != 0, (F.col("key") % 10).cast("double")))
    for s, df in zip(sources, (members, C.TABLES[thing](spark, sf_dir), visits)):
        s.put(df)
    return C._rounded(app.query(query).frame)


def _order_of_events(where: str, last: int | None = None) -> str:
    """``o``: events by member in their order with the label of their thing; ``m`` counts the matches."""
    keep = f"QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY tm DESC, event DESC) <= {last}" if last else ""
    return f"""
  n AS (SELECT count(*) AS n FROM embeddings),
  e AS (SELECT user_id, CAST(event_id AS VARCHAR) AS event, epoch(ts)::BIGINT AS tm, event_id % (SELECT n FROM n) AS thing FROM events WHERE {where}),
  l AS (SELECT user_id, event, tm, label FROM e JOIN embeddings ON vec_id = thing {keep}),
  o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm, event) AS k FROM l)"""


#: Without decay the k-th event of a chain at temperature 1/2 counts 1/k, so that all count the same: a plain mean.
_level = NumberSpace([member.level, thing.label], 0, 10, Mode.SIMILAR)
_index_level = Index(_level, effects=[Effect(_level, visit.member, visit.thing, visit.what == "purchase")], temperature=0.5, event_influence=0.5)
QUERIES["event_effects_number"] = lambda spark, sf_dir: _visited(spark, sf_dir, _index_level, Query(_index_level).find(member).similar(_level, 4.0))
ORACLES["event_effects_number"] = f"""
WITH RECURSIVE {_order_of_events("event_type = 'purchase'")},
  f(user_id, k, num, den) AS (
    SELECT user_id, k, label::DOUBLE, 1.0::DOUBLE FROM o WHERE k = 1
    UNION ALL SELECT o.user_id, o.k, f.num * (o.k - 1) / o.k + o.label / o.k::DOUBLE, f.den * (o.k - 1) / o.k + 1.0 / o.k FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1),
  v AS (SELECT user_id, arg_max(num / den, k) AS v FROM f GROUP BY user_id),
  u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 3 <> 0 THEN (user_id % 10)::DOUBLE END AS own FROM events),
  x AS (SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN v IS NULL THEN own WHEN own IS NULL THEN v ELSE 0.5 * v + 0.5 * own END AS y FROM u LEFT JOIN v USING (user_id))
SELECT id, round(CASE WHEN y IS NULL THEN 0 ELSE cos({C._angle('y', 0.0, 10.0)} - {C._angle('4.0', 0.0, 10.0)}) END, 6) + 0.0 AS score FROM x"""

_kinds = CategoricalSimilaritySpace(thing.kind, ["k1", "k2", "k3"])
_index_kinds = Index(_kinds, effects=[Effect(_kinds, visit.member, 1.0 * visit.thing, visit.what.in_(["click", "purchase"]))], temperature=0.5, event_influence=1.0)
QUERIES["event_effects_category"] = lambda spark, sf_dir: _visited(spark, sf_dir, _index_kinds, Query(_index_kinds).find(member).similar(_kinds, "k1"))
ORACLES["event_effects_category"] = f"""
WITH {_order_of_events("event_type IN ('click', 'purchase')")},
  m AS (SELECT user_id, avg((label = 1)::INT) AS k1, greatest(avg((label = 1)::INT), avg((label = 2)::INT), avg((label = 3)::INT), avg((label NOT IN (1, 2, 3))::INT)) AS top FROM o GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS id, round(k1 / top, 6) + 0.0 AS score FROM m"""

_index_last = Index(_level, effects=[Effect(_level, visit.member, visit.thing, visit.what != "view")], temperature=0.5, event_influence=1.0, max_count=3)
QUERIES["event_effects_last"] = lambda spark, sf_dir: _visited(spark, sf_dir, _index_last, Query(_index_last).find(member).similar(_level, 7.0), distinct_events=True)
ORACLES["event_effects_last"] = f"""
WITH {_order_of_events("event_type <> 'view'", 3)},
  v AS (SELECT user_id, avg(label) AS v FROM o GROUP BY user_id),
  x AS (SELECT CAST(u.user_id AS VARCHAR) AS id, coalesce(v, CASE WHEN u.user_id % 3 <> 0 THEN (u.user_id % 10)::DOUBLE END) AS y FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN v USING (user_id))
SELECT id, round(CASE WHEN y IS NULL THEN 0 ELSE cos({C._angle('y', 0.0, 10.0)} - {C._angle('7.0', 0.0, 10.0)}) END, 6) + 0.0 AS score FROM x"""


# files, stores, look-ups -------------------------------------------------------
def _folder(spark: SparkSession) -> str:
    return kept_for_session(spark, "tables") + "/rows"


def source_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts written in every format and indexed from there: rows and totals per format."""
    base = _folder(spark)
    rows = C._read(spark, sf_dir, "part").selectExpr("p_partkey as key", "p_brand as brand", "p_size as size", "cast(p_retailprice as double) as price")
    line = F.concat(F.lpad(F.col("key").cast("string"), 12, " "), F.rpad("brand", 20, " "), F.lpad(F.col("size").cast("string"), 6, " "), F.lpad(F.col("price").cast("string"), 24, " "))
    out = None
    for f in DataFormat:
        path, options = f"{base}/{f.value}", {}
        if f is DataFormat.FWF:
            rows.select(line.alias("value")).write.text(path)
        else:
            options = {DataFormat.CSV: {"header": "true"}, DataFormat.XML: {"rowTag": "row"}}.get(f, {})
            rows.write.format(f.value).options(**options).save(path)
        widths = (("key", 1, 12), ("brand", 13, 20), ("size", 33, 6), ("price", 39, 24)) if f is DataFormat.FWF else ()
        source = Source(stocked, loader=DataLoaderConfig(path, f, widths=widths), unique=True)
        app = App(spark, [source], [_stock_index], now=C.NOW)
        found = app.query(Query(_stock_index).find(stocked).filter(stocked.size <= 20).select(stocked.size, stocked.brand)).frame
        one = found.agg(F.lit(f.value).alias("format"), F.count("*").alias("n"), F.sum("size").alias("sizes"), F.countDistinct("brand").alias("brands"), F.round(F.sum(F.round("score", 9)), 4).alias("score"))
        out = one if out is None else out.union(one)
    return out


class Stocked(Schema):
    key: IdField
    brand: String
    size: Integer
    price: Float


stocked = Stocked()
_stock_price = NumberSpace(stocked.price, 900, 1000, Mode.MINIMUM)
_stock_index = Index(_stock_price, fields=[stocked.size, stocked.brand])
QUERIES["source_formats"] = source_formats
ORACLES["source_formats"] = f"""
SELECT format, n, sizes, brands, score FROM (SELECT count(*) AS n, sum(p_size)::BIGINT AS sizes, count(DISTINCT p_brand) AS brands, round(sum(round(CASE WHEN price > 1000 THEN 0 ELSE cos({C._angle('price', 900.0, 1000.0)}) END, 9)), 4) AS score
  FROM (SELECT *, p_retailprice::DOUBLE AS price FROM part) WHERE p_size <= 20), (SELECT unnest(['csv', 'fwf', 'xml', 'json', 'parquet', 'orc']) AS format)"""


def persist_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed customers written, read again and asked."""
    path = _folder(spark)
    app = C.app_of(spark, sf_dir, [account], _account_index)
    persist(app.rows(_account_index, account), path, partition_by=["segment"])
    rows = restore(spark, path)
    plan = Query(_account_index).find(account).select(account.segment).filter(account.segment != "BUILDING").bind({}, lambda *_: {}, C.NOW)
    return C._rounded(plan.frame(rows))


_account_index = Index(_balance, fields=[account.segment])
QUERIES["persist_restore"] = persist_restore
ORACLES["persist_restore"] = C._top(_rising, _ACCOUNT, where="WHERE segment <> 'BUILDING'", extra=", segment")


def put_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts put in ten batches by a column that orders them; later values win field by field."""
    source = Source(account, order="at")
    app = App(spark, [source], [_account_index], now=C.NOW)
    rows = C._read(spark, sf_dir, "customer")
    for i in range(10):
        source.put(rows.filter(F.col("c_custkey") % (i + 1) == 0).select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") + i).alias("balance"), F.lit(None).cast("boolean").alias("rich"), F.when(F.lit(i % 2 == 0), F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(f"-{i}"))).alias("segment"), F.lit(i).alias("at")))
    return C._rounded(app.query(Query(_account_index).find(account).select(account.segment)).frame)


QUERIES["put_in_batches"] = put_in_batches
ORACLES["put_in_batches"] = f"""
SELECT id, segment, round(CASE WHEN balance < -1000 THEN 0 ELSE sin({C._angle('balance', -1000.0, 10000.0)}) END, 6) + 0.0 AS score FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal + i AS balance, CASE WHEN i % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || '-' || i END AS segment
  FROM customer JOIN (SELECT unnest(range(10)) AS i) ON c_custkey % (i + 1) = 0 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY i DESC) = 1)"""


def rows_with_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored parts that satisfy a condition and have a brand and words."""
    app = C.app_of(spark, sf_dir, [C.part], Index(_price))
    return app.entities(C.part, filters=[(C.part.size > 5) | (C.part.brand == "Brand#11")], fields=[C.part.brand, C.part.words]).select("id", "brand", "size")


QUERIES["rows_with_fields"] = rows_with_fields
ORACLES["rows_with_fields"] = f"SELECT id, brand, size FROM {C.PART_SQL} WHERE (size > 5 OR brand = 'Brand#11') AND brand IS NOT NULL AND words IS NOT NULL"


def vectors_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of given items, and what the vectors of all items take."""
    index = Index(CustomSpace(C.item.v, 64))
    app = C.app_of(spark, sf_dir, [C.item], index)
    bytes_ = vector_bytes(app.rows(index, C.item), index).select("bytes")
    found = app.vectors(index, C.item, ["3", "14", "159", "none"])
    return found.crossJoin(F.broadcast(bytes_)).select("id", *[(F.round(F.get("vector", F.lit(i)), 6) + 0.0).alias(f"d{i}") for i in (0, 63)], "bytes")


QUERIES["vectors_by_id"] = vectors_by_id
ORACLES["vectors_by_id"] = f"SELECT id, round(v[1], 6) + 0.0 AS d0, round(v[64], 6) + 0.0 AS d63, (SELECT count(*) * 512 FROM embeddings)::BIGINT AS bytes FROM {C.ITEM_SQL} WHERE id IN ('3', '14', '159', 'none')"


def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories read back from stored marks."""
    space = CategoricalSimilaritySpace(C.part.brand, C.BRANDS[:2])
    index = Index(space)
    rows = C.app_of(spark, sf_dir, [C.part], index).rows(index, C.part)
    return rows.select("id", F.array_join(space.labels(F.col("__raw_0")), ",").alias("labels"))


QUERIES["category_labels"] = category_labels
ORACLES["category_labels"] = f"SELECT id, CASE WHEN brand IS NULL THEN NULL WHEN brand IN ('Brand#11', 'Brand#12') THEN brand ELSE 'Brand#11_' END AS labels FROM {C.PART_SQL}"


def json_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's rows as JSON texts."""
    index = Index(_brand, fields=[C.part.brand, C.part.size])
    result = C.app_of(spark, sf_dir, [C.part], index).query(Query(index).find(C.part).filter(C.part.brand == "Brand#13").filter(C.part.size > 3).select(C.part.brand, C.part.size))
    return result.to_json().select(F.get_json_object("value", "$.id").alias("id"), F.sha2("value", 256).alias("sha"))


QUERIES["json_result"] = json_result
ORACLES["json_result"] = f"""SELECT id, sha256('{{"id":"' || id || '","brand":"' || brand || '","size":' || size || ',"score":0.0}}') AS sha FROM {C.PART_SQL} WHERE brand = 'Brand#13' AND size > 3"""


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as base64 text and back, embedded as blobs and compared with the first page."""
    rows = C.TABLES[page](spark, sf_dir).withColumn("body", decode_blob(F.base64("body")))
    source = Source(page, unique=True)
    app = App(spark, [source], [_bytes_index], now=C.NOW)
    source.put(rows)
    return C._rounded(app.query(Query(_bytes_index).find(page).with_vector(page, "1")).frame)


_bytes = ImageSpace(page.body, ByteEmbedder())
_bytes_index = Index(_bytes)
QUERIES["blobs"] = blobs
ORACLES["blobs"] = """
WITH h AS (SELECT CAST(page_id AS VARCHAR) AS id, unnest(regexp_extract_all(hex(encode(html)), '..')) AS h FROM pages),
  c AS (SELECT id, h[1] AS x, count(*)::DOUBLE AS n FROM h GROUP BY ALL),
  z AS (SELECT id, sqrt(sum(n * n)) AS z FROM c GROUP BY id),
  d AS (SELECT c.id, sum(c.n * q.n) AS d FROM c JOIN c q ON q.x = c.x AND q.id = '1' GROUP BY c.id)
SELECT id, round(coalesce(d / (z * (SELECT z FROM z WHERE id = '1')), 0), 6) + 0.0 AS score FROM (SELECT CAST(page_id AS VARCHAR) AS id FROM pages) LEFT JOIN z USING (id) LEFT JOIN d USING (id)"""


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the vectors in both measures, and their halves after a split and a join."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = C._read(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    halves = F.concat(F.slice("v", 33, 32), F.slice("v", 1, 32))
    return rows.select(F.col("vec_id").alias("id"), F.round(V.norm_l1(F.col("v")), 5).alias("l1"), F.round(V.norm_l2(F.col("v"), 64), 5).alias("l2"), F.round(V.dot_columns(F.col("v"), halves), 5).alias("turned"))


QUERIES["vector_norms"] = vector_norms
ORACLES["vector_norms"] = """
WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT id, round(list_sum(list_transform(v, lambda x: abs(x))), 5) AS l1, round(sqrt(list_dot_product(v, v)), 5) AS l2, round(list_dot_product(v, list_concat(v[33:64], v[1:32])), 5) AS turned FROM e"""


def recency_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored recency vectors with an hour offset and a filter, beside the constant query part."""
    space = RecencySpace(C.order.placed, time_period_hour_offset=timedelta(hours=6), period_time_list=[PeriodTime(timedelta(days=500), 2.0)], negative_filter=-0.5)
    index = Index(space)
    rows = index.with_vectors(C.app_of(spark, sf_dir, [C.order], index).rows(index, C.order), Context(C.NOW))
    return rows.select("id", *[(F.round(F.get("vector", F.lit(i)), 6) + 0.0).alias(f"d{i}") for i in range(3)])


_end6 = C.NOW + 86_400 + 21_600
_start6 = C.NOW + 86_400 - 500 * 86_400 + 21_600
QUERIES["recency_offset"] = recency_offset
ORACLES["recency_offset"] = f"""
SELECT id, round(CASE WHEN inside THEN cos(t) ELSE 0 END, 6) + 0.0 AS d0, round(CASE WHEN inside THEN sin(t) ELSE 0 END, 6) + 0.0 AS d1, CASE WHEN inside THEN 0.0 ELSE -0.5 END::DOUBLE AS d2
FROM (SELECT id, placed BETWEEN {_start6} AND {_end6} AS inside, (placed - {_start6}) / {float(_end6 - _start6)} * {C._HALF} AS t FROM {C.ORDER_SQL})"""
