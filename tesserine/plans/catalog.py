"""Registered queries over the driver's tables, with their DuckDB twins.

Each query reads its whole tables; limits occur only where a top-k is what is asked for. Scores are
rounded to six digits on both sides and ordered at twelve, ties by id as text.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.text import chunked
from tesserine.operators.index import Effect, Index
from tesserine.operators.spaces import CategoricalSimilaritySpace, Context, CustomSpace, LogarithmicScale, Mode, NumberSpace, PeriodTime, RecencySpace, TextSimilaritySpace
from tesserine.plans.app import App, Source
from tesserine.plans.query import Param, Query, batch_top_k
from tesserine.schema import CreatedAtField, EventSchema, Float, FloatList, IdField, Integer, Schema, SchemaReference, String, StringList, Timestamp
from tesserine.sources.readers import from_json
from tesserine.sources.store import upsert

QUERIES: dict = {}
ORACLES: dict = {}

NOW = 996_710_400  # 2001-08-02, the day after the last order
EVENTS_NOW = 1_706_659_200  # 2024-01-31
BRANDS = ["Brand#11", "Brand#12", "Brand#13", "Brand#21"]


class Part(Schema):
    key: IdField
    name: String
    brand: String | None
    type: String
    size: Integer | None
    price: Float
    words: StringList | None


class Order(Schema):
    key: IdField
    placed: Timestamp
    total: Float
    status: String
    priority: String | None


class Customer(Schema):
    key: IdField
    balance: Float
    segment: String


class Supplier(Schema):
    key: IdField
    balance: Float


class Item(Schema):
    key: IdField
    v: FloatList
    label: Integer


class Document(Schema):
    key: IdField
    text: String | None
    lang: String | None


class User(Schema):
    key: IdField


class Interaction(EventSchema):
    key: IdField
    created_at: CreatedAtField
    user: SchemaReference[User]
    item: SchemaReference[Item]
    kind: String


part, order, customer, supplier, item, document, user, interaction = Part(), Order(), Customer(), Supplier(), Item(), Document(), User(), Interaction()


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Two nullable columns are made for the rules about missing values.
TABLES = {
    part: lambda s, d: _read(s, d, "part").selectExpr("p_partkey as key", "p_name as name", "nullif(p_brand, 'Brand#12') as brand", "p_type as type", "nullif(p_size, 7) as size", "p_retailprice as price", "if(p_size = 9, null, split(lower(p_type), ' ')) as words"),
    order: lambda s, d: _read(s, d, "orders").selectExpr("o_orderkey as key", "o_orderdate as placed", "o_totalprice as total", "o_orderstatus as status", "nullif(o_orderpriority, '3-MEDIUM') as priority"),
    customer: lambda s, d: _read(s, d, "customer").selectExpr("c_custkey as key", "c_acctbal as balance", "c_mktsegment as segment"),
    supplier: lambda s, d: _read(s, d, "supplier").selectExpr("s_suppkey as key", "s_acctbal as balance"),
    item: lambda s, d: _read(s, d, "embeddings").selectExpr("vec_id as key", "embedding as v", "label"),
    document: lambda s, d: _read(s, d, "documents").selectExpr("doc_id as key", "text", "lang"),
}
PART_SQL = "(SELECT CAST(p_partkey AS VARCHAR) AS id, nullif(p_brand, 'Brand#12') AS brand, p_type AS type, nullif(p_size, 7) AS size, p_retailprice AS price, CASE WHEN p_size = 9 THEN NULL ELSE string_split(lower(p_type), ' ') END AS words FROM part)"
ORDER_SQL = "(SELECT CAST(o_orderkey AS VARCHAR) AS id, epoch(o_orderdate)::BIGINT AS placed, o_totalprice AS total, o_orderstatus AS status, nullif(o_orderpriority, '3-MEDIUM') AS priority FROM orders)"
ITEM_SQL = "(SELECT CAST(vec_id AS VARCHAR) AS id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"


def app_of(spark: SparkSession, sf_dir: str, schemas, index: Index, now: int = NOW) -> App:
    sources = [Source(s, unique=True) for s in schemas]
    app = App(spark, sources, [index], now=now)
    for s in sources:
        s.put(TABLES[s.schema](spark, sf_dir))
    return app


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6) + 0.0)


def register(name: str, index: Index, query: Query, sql: str | None, schemas=None, now: int = NOW, shape=_rounded, **params):
    schemas = schemas or [query.schema]
    QUERIES[name] = lambda spark, sf_dir: shape(app_of(spark, sf_dir, schemas, index, now).query(query, **params).frame)
    if sql is not None:
        ORACLES[name] = sql


def _top(select: str, source: str, limit: int | None = None, where: str = "", extra: str = "") -> str:
    """``select`` is the score; the rest as the engine orders it."""
    tail = f" ORDER BY round(s, 12) DESC, id LIMIT {limit}" if limit else ""
    return f"SELECT id{extra}, round(s, 6) + 0.0 AS score FROM (SELECT *, {select} AS s FROM {source} t {where}){tail}"


# numbers ---------------------------------------------------------------------
_HALF = "(pi() / 2)"


def _angle(x: str, lo: float, hi: float) -> str:
    return f"((least(greatest({x}, {lo}), {hi}) - {lo}) / ({hi} - {lo}) * {_HALF})"


_space = NumberSpace(part.price, 900, 1000, Mode.MINIMUM)
_index = Index(_space, fields=[part.type, part.size])
register("number_min", _index, Query(_index).find(part).filter(part.size > 10).limit(100), _top(f"CASE WHEN price > 1000 THEN 0 ELSE cos({_angle('price', 900.0, 1000.0)}) END", PART_SQL, 100, "WHERE size > 10"))

_space = NumberSpace(customer.balance, -500, 9000, Mode.MAXIMUM, negative_filter=-0.5)
_index = Index(_space)
_CUSTOMER = "(SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer)"
register("number_max", _index, Query(_index).find(customer), _top(f"CASE WHEN balance < -500 THEN -0.5 ELSE sin({_angle('balance', -500.0, 9000.0)}) END", _CUSTOMER))

_space = NumberSpace(part.size, 1, 40, Mode.SIMILAR)
_index = Index(_space, fields=[part.brand])
register("number_similar", _index, Query(_index).find(part).similar(_space, Param("size")), _top(f"CASE WHEN size IS NULL OR size > 40 THEN 0 ELSE cos({_angle('size', 1.0, 40.0)} - {_angle('20.0', 1.0, 40.0)}) END", PART_SQL), size=20)

_space = NumberSpace(order.total, 0, 400000, Mode.MINIMUM, scale=LogarithmicScale())
_index = Index(_space)
register("number_log", _index, Query(_index).find(order).limit(50), _top(f"CASE WHEN total > 400000 THEN 0 ELSE cos(log10(1 + greatest(total, 0)) / log10(400001.0) * {_HALF}) END", ORDER_SQL, 50))


# recency ---------------------------------------------------------------------
def _recency(periods: list[tuple[int, float]], negative: float = 0.0) -> str:
    """Periods as (days, weight); the end of the day after NOW is the reference."""
    end, total = NOW + 86_400, sum(w * w for _, w in periods)
    terms = []
    for days, w in periods:
        start = end - days * 86_400
        terms.append(f"CASE WHEN placed BETWEEN {start} AND {end} THEN {w * w / total} * cos(({NOW} - placed) / {float(end - start)} * {_HALF}) ELSE 0 END")
    last = end - max(d for d, _ in periods) * 86_400
    return " + ".join(terms) + f" + CASE WHEN placed BETWEEN {last} AND {end} THEN 0 ELSE {negative} END"


for _name, _periods, _negative in (("recency_single", [(14, 1.0)], 0.0), ("recency_multi_period", [(30, 1.0), (365, 2.0)], 0.0), ("recency_negative_filter", [(100, 1.0), (700, 0.5)], -0.25)):
    _space = RecencySpace(order.placed, period_time_list=[PeriodTime(timedelta(days=d), w) for d, w in _periods], negative_filter=_negative)
    _index = Index(_space, fields=[order.status])
    register(_name, _index, Query(_index).find(order), _top(_recency(_periods, _negative), ORDER_SQL))


# categories ------------------------------------------------------------------
def _marks(c: str) -> str:
    return f"CASE WHEN brand = '{c}' THEN 1.0 ELSE 0.0 END"


_space = CategoricalSimilaritySpace(part.brand, BRANDS)
_index = Index(_space)
register("category_single", _index, Query(_index).find(part).similar(_space, ["Brand#13"]), _top(_marks("Brand#13"), PART_SQL))
register("category_multi", _index, Query(_index).find(part).similar(_space, ["Brand#11", "Brand#21"]).similar(_space, ["Brand#13"], -1.0), _top(f"({_marks('Brand#11')} + {_marks('Brand#21')} - {_marks('Brand#13')}) / 2", PART_SQL))
register("category_other", _index, Query(_index).find(part).similar(_space, ["something else"]), _top("CASE WHEN brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') THEN 1.0 ELSE 0.0 END", PART_SQL))
_space = CategoricalSimilaritySpace(customer.segment, ["BUILDING", "MACHINERY", "AUTOMOBILE"], negative_filter=-0.2)
_index = Index(_space)
register("category_negative_filter", _index, Query(_index).find(customer).similar(_space, ["BUILDING", "MACHINERY"]), _top("CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN 0.5 - 0.2 * sqrt(3.0) / 2 ELSE -0.2 * sqrt(3.0) END", _CUSTOMER))

# custom vectors --------------------------------------------------------------
_space = CustomSpace(item.v, 64)
_index = Index(_space, fields=[item.label])
_probe = [((i * 7) % 11) - 5.0 for i in range(64)]
_unit = f"list_transform({_probe}::DOUBLE[], lambda x: x / sqrt(list_dot_product({_probe}::DOUBLE[], {_probe}::DOUBLE[])))"
register("custom_topk", _index, Query(_index).find(item).similar(_space, _probe).filter(item.label != 3).limit(20), _top(f"list_dot_product(v, {_unit})", ITEM_SQL, 20, "WHERE label IS DISTINCT FROM 3"))
register("custom_radius", _index, Query(_index).find(item).similar(_space, _probe).radius(0.9, digits=6), f"SELECT * FROM ({_top(f'list_dot_product(v, {_unit})', ITEM_SQL)}) WHERE score >= 0.1")
register("with_vector_custom", _index, Query(_index).find(item).with_vector(item, Param("like")).select(item.label).limit(25), _top("list_dot_product(v, (SELECT v FROM " + ITEM_SQL + " WHERE id = '7'))", ITEM_SQL, 25, extra=", label"), like="7")

# several spaces --------------------------------------------------------------
_price, _brand, _size = NumberSpace(part.price, 900, 1000, Mode.MINIMUM), CategoricalSimilaritySpace(part.brand, BRANDS), NumberSpace(part.size, 1, 50, Mode.SIMILAR)
_index = Index([_price, _brand, _size], fields=[part.type, part.size, part.brand, part.words, part.name], fields_to_exclude=[part.name])
_s1 = f"cos({_angle('price', 900.0, 1000.0)})"
_s2 = f"(({_marks('Brand#11')} + {_marks('Brand#13')}) / 2)"
_s3 = f"(CASE WHEN size IS NULL THEN 0 ELSE cos({_angle('size', 1.0, 50.0)} - {_angle('15.0', 1.0, 50.0)}) END)"
_many = Query(_index, weights={_price: 1.0, _brand: Param("brand_weight", default=2.0)}).find(part).similar(_brand, ["Brand#11", "Brand#13"]).similar(_size, 15, 0.5)
_all = f"({_s1} + 2 * {_s2} + {_s3}) / (sqrt(6.0) * sqrt(3.0))"
register("weighted_multi_space", _index, _many.filter(part.type != "STANDARD").filter((part.size > 5) | (part.brand == "Brand#11")).select(part.brand, part.price).limit(50), _top(_all, PART_SQL, 50, "WHERE type <> 'STANDARD' AND (size > 5 OR brand = 'Brand#11')", ", brand, price"))
register("default_weights", _index, Query(_index).find(part).similar(_size, 15).limit(200), _top(_s3, PART_SQL, 200))


def _partials(df: DataFrame) -> DataFrame:
    return df.select("id", *[(F.round(F.col("partial_scores")[i], 6) + 0.0).alias(f"part_{i}") for i in range(3)], (F.round("score", 6) + 0.0).alias("score"))


register("partial_scores", _index, _many.include_metadata(), f"SELECT id, round({_s1} / sqrt(18.0), 6) + 0.0 AS part_0, round(2 * {_s2} / sqrt(18.0), 6) + 0.0 AS part_1, round({_s3} / sqrt(18.0), 6) + 0.0 AS part_2, round({_all}, 6) + 0.0 AS score FROM {PART_SQL} t", shape=_partials)


def _parts(df: DataFrame) -> DataFrame:
    at = lambda i, j: (F.round(F.col("vector_parts")[i][j], 6) + 0.0).alias(f"v_{i}_{j}")
    return df.select("id", at(0, 0), at(0, 1), at(1, 0), at(1, 4))


register("vector_parts", _index, Query(_index).find(part).select(metadata=[_brand, _price]), f"SELECT id, round(sin({_angle('price', 900.0, 1000.0)}) / sqrt(3.0), 6) + 0.0 AS v_0_0, round(cos({_angle('price', 900.0, 1000.0)}) / sqrt(3.0), 6) + 0.0 AS v_0_1, round({_marks('Brand#11')} / sqrt(12.0), 6) + 0.0 AS v_1_0, round(CASE WHEN brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') THEN 1.0 ELSE 0.0 END / sqrt(12.0), 6) + 0.0 AS v_1_4 FROM {PART_SQL} t", shape=_parts)
register("projection_exclude", _index, _many.select_all(), f"SELECT id, brand, type, size, price, array_to_string(words, ',') AS words, round({_all}, 6) + 0.0 AS score FROM {PART_SQL} t", shape=lambda df: _rounded(df.withColumn("words", F.array_join("words", ","))))
register("with_vector_multi", _index, Query(_index, weights={_price: 0.0}).find(part).with_vector(part, "3", {_brand: 1.0, _size: 2.0}).limit(100), f"""
WITH p AS (SELECT * FROM {PART_SQL}), q AS (SELECT brand AS qb, size AS qs FROM p WHERE id = '3'),
  g AS (SELECT *, CASE WHEN brand IS NULL THEN 0 WHEN brand IN ('Brand#11','Brand#12','Brand#13','Brand#21') THEN 1 ELSE 2 END AS kind, CASE WHEN qb IS NULL THEN 0 WHEN qb IN ('Brand#11','Brand#12','Brand#13','Brand#21') THEN 1 ELSE 2 END AS qkind FROM p, q),
  s AS (SELECT id, CASE WHEN qkind = 0 THEN 0.0 WHEN kind = qkind AND (kind = 2 OR brand = qb) THEN 1.0 ELSE 0.0 END AS s2, CASE WHEN size IS NULL OR qs IS NULL THEN 0.0 ELSE cos({_angle('size', 1.0, 50.0)} - {_angle('qs', 1.0, 50.0)}) END AS s3, CASE WHEN qkind = 0 THEN 0 ELSE 1 END AS a2, CASE WHEN qs IS NULL THEN 0 ELSE 1 END AS a3 FROM g)
SELECT id, round(t, 6) + 0.0 AS score FROM (SELECT id, (s2 + s3) / (sqrt(a2 + a3) * sqrt(a2 + a3)) AS t FROM s) ORDER BY round(t, 12) DESC, id LIMIT 100""")

# filters ---------------------------------------------------------------------
_FILTERS = {
    "eq": (part.brand == "Brand#13", "brand = 'Brand#13'"),
    "ne": (part.brand != "Brand#13", "brand IS DISTINCT FROM 'Brand#13'"),
    "gt": (part.size > 30, "size > 30"),
    "lt": (part.size < 12, "size < 12"),
    "ge": (part.size >= 30, "size >= 30"),
    "le": (part.size <= 12, "size <= 12"),
    "in": (part.brand.in_(["Brand#11", "Brand#13", "none"]), "brand IN ('Brand#11', 'Brand#13', 'none')"),
    "not_in": (part.brand.not_in_(["Brand#11", "Brand#13"]), "(brand NOT IN ('Brand#11', 'Brand#13') OR brand IS NULL)"),
    "contains": (part.words.contains(["small", "promo"]), "list_has_any(words, ['small', 'promo'])"),
    "not_contains": (part.words.not_contains(["small", "promo"]), "words IS NOT NULL AND NOT list_has_any(words, ['small', 'promo'])"),
    "contains_all": (part.words.contains_all(["promo"]), "(words IS NULL OR list_has_all(words, ['promo']))"),
    "or": ((part.brand == "Brand#13") | (part.size == 4) | (part.type != "SMALL"), "(brand = 'Brand#13' OR size = 4 OR type <> 'SMALL')"),
    "id": (part.key.in_(["1", "10", "77"]), "id IN ('1', '10', '77')"),
}
for _name, (_where, _sql) in _FILTERS.items():
    register(f"filter_{_name}", _index, Query(_index).find(part).filter(_where), f"SELECT id, 0.0::DOUBLE AS score FROM {PART_SQL} t WHERE {_sql}")
register("filter_param_skipped", _index, Query(_index).find(part).filter(part.brand == Param("brand")).filter(part.size <= Param("most")), f"SELECT id, 0.0::DOUBLE AS score FROM {PART_SQL} t WHERE size <= 8", most=8)

# one space over two schemas ------------------------------------------------------
_balance = NumberSpace([customer.balance, supplier.balance], -1000, 10000, Mode.SIMILAR)
_index = Index(_balance)
register("multi_schema_space", _index, Query(_index).find(supplier).with_vector(customer, "1"), f"SELECT CAST(s_suppkey AS VARCHAR) AS id, round(cos({_angle('s_acctbal', -1000.0, 10000.0)} - {_angle('(SELECT c_acctbal FROM customer WHERE c_custkey = 1)', -1000.0, 10000.0)}), 6) + 0.0 AS score FROM supplier", [supplier, customer])

# text ------------------------------------------------------------------------
_text = TextSimilaritySpace(document.text)
_index = Index(_text, fields=[document.lang])
_HASHED = """regexp_extract_all(lower({0}), '[a-z0-9]+')"""
register("text_similar", _index, Query(_index).find(document).similar(_text, Param("about")).filter(document.lang != "de").limit(50), f"""
WITH w AS (SELECT doc_id, unnest({_HASHED.format('text')}) AS w FROM documents WHERE lang IS DISTINCT FROM 'de'),
  h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS b, CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT < 8 THEN 1.0 ELSE -1.0 END AS s FROM w),
  c AS (SELECT doc_id, b, sum(s) AS n FROM h GROUP BY ALL),
  q AS (SELECT ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS b, sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT < 8 THEN 1.0 ELSE -1.0 END) AS m FROM (SELECT unnest({_HASHED.format("'the and of worthless stories'")}) AS w) GROUP BY b),
  d AS (SELECT c.doc_id, coalesce(sum(n * m), 0) / nullif(sqrt(sum(n * n)), 0) / (SELECT sqrt(sum(m * m)) FROM q) AS s FROM c LEFT JOIN q USING (b) GROUP BY c.doc_id)
SELECT id, round(s, 6) + 0.0 AS score FROM (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(s, 0) AS s FROM documents LEFT JOIN d USING (doc_id) WHERE lang IS DISTINCT FROM 'de') ORDER BY round(s, 12) DESC, id LIMIT 50""", about="the and of worthless stories")


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per document with their total and greatest length."""
    rows = chunked(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy(F.col("origin_id").alias("id")).agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"), F.max(F.length("chunk")).alias("longest"))


QUERIES["text_chunks"] = text_chunks
#: Pieces by one list step per separator, then one recursive row per chunk over the running lengths of the pieces.
_CUT = r"""list_concat([], flatten(list_transform({0}, lambda p: CASE WHEN len(p) > {2} THEN regexp_extract_all(p, '[^{1}]*[{1}] ?|[^{1}]+') ELSE [p] END)))"""


def _chunks_sql(size: int, overlap: int, source: str) -> str:
    """(id, pos, chunk) of ``source`` (id, text)."""
    pieces = "[flat]"
    for sep in ".!? ":
        pieces = _CUT.format(pieces, sep, size)
    return rf"""
WITH RECURSIVE
  f AS (SELECT id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS flat FROM {source}),
  p AS (SELECT id, {pieces} AS p FROM f WHERE flat <> ''),
  x AS (SELECT id, generate_subscripts(p, 1) AS i, len(unnest(p)) AS n FROM p),
  c AS (SELECT id, i, n, sum(n) OVER (PARTITION BY id ORDER BY i) AS t FROM x),
  l AS (SELECT id, list(n ORDER BY i) AS n, list_concat([0], list(t ORDER BY i)) AS t FROM c GROUP BY id),
  w(id, k, a, b) AS (
    SELECT id, 0, 0, greatest(1, len(list_filter(t, lambda y: y <= {size})) - 1) FROM l
    UNION ALL
    SELECT id, k + 1, a, greatest(b + 1, len(list_filter(t, lambda y: y <= t[a + 1] + {size})) - 1) FROM (
      SELECT w.id, k, b, t, len(list_filter(t, lambda y: y < t[b + 1] - greatest(0, least({overlap}, {size} - n[b + 1])))) AS a
      FROM w JOIN l ON l.id = w.id WHERE b < len(n)))
SELECT w.id, k AS pos, trim(array_to_string(p[a + 1:b], ''), ' ') AS chunk FROM w JOIN p ON p.id = w.id"""


ORACLES["text_chunks"] = f"SELECT id, count(*) AS n_chunks, sum(len(chunk))::BIGINT AS n_chars, max(len(chunk)) AS longest FROM ({_chunks_sql(250, 20, '(SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents)')}) WHERE chunk <> '' GROUP BY id"


# events ----------------------------------------------------------------------
_taste = CustomSpace([item.v], 64)
_effects_index = Index(
    _taste,
    effects=[Effect(_taste, interaction.user, 1.0 * interaction.item, interaction.kind == "purchase"), Effect(_taste, interaction.user, 0.3 * interaction.item, interaction.kind.in_(["click", "view"]))],
    temperature=0.25, event_influence=1.0, time_decay_floor=0.5, max_age=timedelta(days=20),
)


def _interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event names its user and an item: the event's number over the count of items."""
    n = _read(spark, sf_dir, "embeddings").count()
    events = _read(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("created_at"), F.col("user_id").alias("user"), (F.col("event_id") % n).alias("item"), F.col("event_type").alias("kind"))
    return events


def _user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [Source(s, unique=True) for s in (user, item, interaction)]
    app = App(spark, sources, [_effects_index], now=EVENTS_NOW)
    events = _interactions(spark, sf_dir)
    for s, df in zip(sources, (events.select(F.col("user").alias("key")).distinct(), TABLES[item](spark, sf_dir), events)):
        s.put(df)
    rows = app.rows(_effects_index, user)
    return rows.filter(F.col("__raw_0").isNotNull()).select("id", F.col("__raw_0").alias("vector"))


def event_effects_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's vector after all events, four of its dimensions and its norm."""
    from tesserine.functions.vectors import norm_l2

    return _user_vectors(spark, sf_dir).select("id", *[(F.round(F.get("vector", F.lit(i)), 6) + 0.0).alias(f"d{i}") for i in (0, 1, 31, 63)], F.round(norm_l2(F.col("vector"), 64), 6).alias("norm"))


def event_effects_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest items of every user after all events."""
    rows = app_of(spark, sf_dir, [item], _effects_index).rows(_effects_index, item)
    top = batch_top_k(rows.withColumnRenamed("__raw_0", "vector"), _user_vectors(spark, sf_dir).withColumnsRenamed({"id": "query_id", "vector": "query"}), 64, 5)
    return top.select(F.col("query_id").alias("user_id"), "id", "rank", (F.round("score", 5) + 0.0).alias("score"))


QUERIES |= {"event_effects_vector": event_effects_vector, "event_effects_topk": event_effects_topk}
_FOLD = f"""
WITH RECURSIVE
  n AS (SELECT count(*) AS n FROM embeddings),
  e AS (SELECT event_id, user_id, epoch(ts)::BIGINT AS tm, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.3 END AS w, CAST(event_id % (SELECT n FROM n) AS VARCHAR) AS item
        FROM events WHERE event_type IN ('purchase', 'click', 'view')),
  i AS (SELECT id, v FROM {ITEM_SQL}),
  o AS (SELECT user_id, tm, list_transform(v, lambda x: x * w) AS a, row_number() OVER (PARTITION BY user_id ORDER BY tm, CAST(event_id AS VARCHAR)) AS k FROM e JOIN i ON i.id = e.item),
  f(user_id, k, at_avg, oldest, vec) AS (
    SELECT user_id, k, tm, tm, a FROM o WHERE k = 1
    UNION ALL
    SELECT user_id, k, at_avg, oldest, list_transform(list_zip(a, vec), lambda z: (0.25 * z[1] + s * z[2]) / (0.25 + s)) FROM (
      SELECT *, (CASE WHEN 1728000 < {EVENTS_NOW} - at_avg THEN 0 ELSE (1 - ({EVENTS_NOW} - at_avg) / 1728000.0) * 0.5 + 0.5 END) * (k - 1) * 0.75 AS s FROM (
        SELECT o.user_id, o.k, ceil((f.at_avg * f.k + o.tm) / o.k::DOUBLE)::BIGINT AS at_avg, least(f.oldest, o.tm) AS oldest, o.a AS a, f.vec AS vec
        FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1))),
  last AS (SELECT user_id, arg_max(vec, k) AS v FROM f GROUP BY user_id),
  u AS (SELECT CAST(user_id AS VARCHAR) AS id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM last)
"""
ORACLES["event_effects_vector"] = _FOLD + "SELECT id, round(v[1], 6) + 0.0 AS d0, round(v[2], 6) + 0.0 AS d1, round(v[32], 6) + 0.0 AS d31, round(v[64], 6) + 0.0 AS d63, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM u"
ORACLES["event_effects_topk"] = _FOLD + """
SELECT user_id, id, rank, round(s, 5) + 0.0 AS score FROM (
  SELECT u.id AS user_id, i.id AS id, list_dot_product(u.v, i.v) AS s, row_number() OVER (PARTITION BY u.id ORDER BY round(list_dot_product(u.v, i.v), 9) DESC, i.id) AS rank FROM u, i)
WHERE rank <= 5"""


# many queries, merges, paths --------------------------------------------------
def batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest items of every item whose id is divisible by 100."""
    from tesserine.functions.vectors import unit

    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id"), unit(F.col("embedding"), 64).alias("vector"))
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    top = batch_top_k(vectors, queries, 64, 10, id_col="vec_id")
    return top.select("query_id", "id", "rank", (F.round("score", 5) + 0.0).alias("score"))


QUERIES["batch_queries"] = batch_queries
ORACLES["batch_queries"] = f"""
WITH i AS (SELECT id, v FROM {ITEM_SQL})
SELECT query_id, id, rank, round(s, 5) + 0.0 AS score FROM (
  SELECT CAST(q.id AS BIGINT) AS query_id, i.id AS id, list_dot_product(q.v, i.v) AS s, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, i.v), 9) DESC, i.id) AS rank
  FROM i q, i WHERE CAST(q.id AS BIGINT) % 100 = 0) WHERE rank <= 10"""


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts updated field by field: new prices of small ones, and parts that appear first in the update."""
    old = part.read(TABLES[part](spark, sf_dir)).select("id", "brand", "size", "price")
    raw = _read(spark, sf_dir, "part")
    new = raw.filter("p_size < 10").selectExpr("cast(p_partkey as string) as id", "cast(null as string) as brand", "cast(p_retailprice * 2 as double) as price")
    added = raw.filter("p_size = 50").selectExpr("concat('new-', p_partkey) as id", "p_brand as brand", "cast(null as double) as price")
    return upsert(old, new.union(added)).select("id", "brand", "size", F.round("price", 4).alias("price"))


QUERIES["upsert_merge"] = upsert_merge
ORACLES["upsert_merge"] = f"""
SELECT id, brand, size, round(price, 4) AS price FROM (
  SELECT o.id, o.brand, o.size::BIGINT AS size, CASE WHEN p.p_size < 10 THEN p.p_retailprice * 2 ELSE o.price END AS price FROM {PART_SQL} o JOIN part p ON CAST(p.p_partkey AS VARCHAR) = o.id
  UNION ALL SELECT 'new-' || p_partkey, p_brand, NULL, NULL FROM part WHERE p_size = 50)"""


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type with the number inside their JSON, reached by path."""
    events = from_json(_read(spark, sf_dir, "events"), "props", {"k": "k"}).withColumn("k", F.col("k").cast("long"))
    return events.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


QUERIES["json_paths"] = json_paths
ORACLES["json_paths"] = "SELECT event_type, count(json_extract_string(props, '$.k')) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total, max(json_extract_string(props, '$.k')::BIGINT) AS most FROM events GROUP BY event_type"


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of all customers over a number and a category space."""
    index = Index([NumberSpace(customer.balance, 0, 10000, Mode.MAXIMUM, negative_filter=-1.0), CategoricalSimilaritySpace(customer.segment, ["BUILDING", "MACHINERY"])])
    rows = index.with_vectors(app_of(spark, sf_dir, [customer], index).rows(index, customer), Context(NOW))
    return rows.select("id", *[(F.round(F.get("vector", F.lit(i)), 6) + 0.0).alias(f"d{i}") for i in range(6)])


QUERIES["stored_vectors"] = stored_vectors
ORACLES["stored_vectors"] = f"""
SELECT id, round(CASE WHEN balance < 0 THEN 0 ELSE sin({_angle('balance', 0.0, 10000.0)}) / sqrt(2.0) END, 6) + 0.0 AS d0, round(CASE WHEN balance < 0 THEN 0 ELSE cos({_angle('balance', 0.0, 10000.0)}) / sqrt(2.0) END, 6) + 0.0 AS d1,
  CASE WHEN balance < 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS d2, CASE WHEN segment = 'BUILDING' THEN 0.5 ELSE 0.0 END::DOUBLE AS d3, CASE WHEN segment = 'MACHINERY' THEN 0.5 ELSE 0.0 END::DOUBLE AS d4, CASE WHEN segment NOT IN ('BUILDING', 'MACHINERY') THEN 0.5 ELSE 0.0 END::DOUBLE AS d5
FROM {_CUSTOMER}"""
