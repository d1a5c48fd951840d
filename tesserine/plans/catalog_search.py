"""Registered queries that search by cells, codes and learned vectors, and that stream or store what others compute anew."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.images import GradientEmbedder, decode_image, resize_blobs
from tesserine.functions.learned import LearnedEmbedder, information, pair_counts, vocabulary, word_counts
from tesserine.functions.text import CachedEmbedder, HashedEmbedder
from tesserine.functions.vectors import norm_l1, unit
from tesserine.operators.codes import CodeIndex
from tesserine.operators.effects import rule_of
from tesserine.operators.index import Effect, Index
from tesserine.operators.spaces import CategoricalSimilaritySpace, CustomSpace, ImageSpace, Mode, NumberSpace, TextSimilaritySpace
from tesserine.plans import catalog as C
from tesserine.plans import catalog_more as M
from tesserine.plans.app import App, Source
from tesserine.plans.inspect import stored_bytes
from tesserine.plans.natural import SlotFiller
from tesserine.plans.query import Param, Query, batch_top_k
from tesserine.schema import Blob, IdField, Schema
from tesserine.sources.plugin import Condition, plugged
from tesserine.sources.store import kept_for_session, persist, restore, tee, write_shared
from tesserine.sources.stored import StoredEmbeddings, persist_clustered
from tesserine.streaming.effects import batch_states, ordered_effects, run_available, with_values

QUERIES, ORACLES = M.QUERIES, M.ORACLES


# cells -------------------------------------------------------------------------
def dealt(index: Index, schema, query: Query, sql: str, name: str) -> None:
    """``query`` over rows that are written in cells first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        app = C.app_of(spark, sf_dir, [schema], index)
        app.deal(index, schema)
        return C._rounded(app.query(query).frame)

    QUERIES[name], ORACLES[name] = run, sql


_vectors = CustomSpace(C.item.v, 64)
_index = Index(_vectors, fields=[C.item.label])
_asked = Query(_index).find(C.item).similar(_vectors, C._probe)
dealt(_index, C.item, _asked.filter(C.item.label != 3).limit(20), ORACLES["custom_topk"], "cells_topk")
dealt(_index, C.item, _asked.radius(0.9, digits=6), ORACLES["custom_radius"], "cells_radius")
_price, _brand, _size = NumberSpace(C.part.price, 900, 1000, Mode.MINIMUM), CategoricalSimilaritySpace(C.part.brand, C.BRANDS), NumberSpace(C.part.size, 1, 50, Mode.SIMILAR)
_several = Index([_price, _brand, _size], fields=[C.part.type, C.part.size, C.part.brand])
_weighted = Query(_several, weights={_price: 1.0, _brand: 2.0}).find(C.part).similar(_brand, ["Brand#11", "Brand#13"]).similar(_size, 15, 0.5)
dealt(_several, C.part, _weighted.filter(C.part.type != "STANDARD").filter((C.part.size > 5) | (C.part.brand == "Brand#11")).select(C.part.brand, C.part.price).limit(50), ORACLES["weighted_multi_space"], "cells_multi_space")


def cells_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest items of every item whose id is divisible by 100, by cells."""
    app = C.app_of(spark, sf_dir, [C.item], _index)
    cells = app.deal(_index, C.item)
    top = cells.batch(_asked_of(spark, sf_dir)[1], 10)
    return top.select("query_id", "id", "rank", (F.round("score", 5) + 0.0).alias("score"))


QUERIES["cells_batch"], ORACLES["cells_batch"] = cells_batch, ORACLES["batch_queries"]


# codes -------------------------------------------------------------------------
def _asked_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Unit vectors of all items, and of those whose id is divisible by 100 as queries."""
    vectors = C._read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), unit(F.col("embedding"), 64).alias("vector"))
    return vectors, vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


def codes_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the ten nearest items of each query the compressed vectors find, with their exact scores."""
    vectors, asked = _asked_of(spark, sf_dir)
    index = CodeIndex.build(vectors, 64)
    return index.recall(asked, 10)


def codes_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest items by compressed vectors where all items are candidates: the exact result."""
    vectors, asked = _asked_of(spark, sf_dir)
    index = CodeIndex.build(vectors, 64)
    top = index.search(asked, 10, candidates=max(10, vectors.count()))
    return top.select("query_id", "id", "rank", (F.round("score", 5) + 0.0).alias("score"))


QUERIES |= {"codes_recall": codes_recall, "codes_topk": codes_topk}
ORACLES["codes_topk"] = ORACLES["batch_queries"]


# the fold as a stream ------------------------------------------------------------
#: Events before this instant are folded in a batch, which the stream starts from.
HISTORY = C.EVENTS_NOW - 15 * 86_400


def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member's level after all purchases: those before ``HISTORY`` by the batch fold, the later ones as a stream of the event files."""
    path = kept_for_session(spark, "stream")
    index = M._index_level
    app = App(spark, [source := Source(M.thing, unique=True)], [index], now=C.EVENTS_NOW)
    source.put(C.TABLES[M.thing](spark, sf_dir))
    things = app.rows(index, M.thing)
    n = C._read(spark, sf_dir, "embeddings").count()

    def events(df: DataFrame) -> DataFrame:
        named = df.selectExpr("cast(event_id as string) as id", "unix_timestamp(ts) as created_at", "cast(user_id as string) as member", f"cast(event_id % {n} as string) as thing", "event_type as what")
        return with_values(named, things, M._level, index.raw_column(M._level), "member", "thing", index.effects)

    stored = spark.read.parquet(f"{sf_dir}/events.parquet")
    rule = rule_of(index, C.EVENTS_NOW)
    start = write_shared(batch_states(events(stored).filter(F.col("created_at") < HISTORY), rule))
    files = f"{sf_dir}/events.parque[t]"  # as a pattern, a table of one file is taken as well as a folder of files
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 8).parquet(files)
    updates = ordered_effects(events(stream).filter(F.col("created_at") >= HISTORY), rule, "30 days", start)
    last = run_available(updates, path)
    quiet = start.join(last.select("entity"), "entity", "left_anti")  # members without an event in the stream
    return last.unionByName(quiet).select(F.col("entity").alias("id"), "count", (F.round(F.get("value", F.lit(0)), 6) + 0.0).alias("level"))


QUERIES["stream_fold"] = stream_fold
ORACLES["stream_fold"] = f"""
WITH {M._order_of_events("event_type = 'purchase'")}
SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS count, round(avg(label), 6) + 0.0 AS level FROM o GROUP BY user_id"""


# word vectors from the corpus ------------------------------------------------------
def word_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word of the vocabulary its occurrences, the words it stands near, how often, and the sum of the information."""
    docs = C._read(spark, sf_dir, "documents")
    words, n = vocabulary(write_shared(word_counts(docs, "text")))
    named = spark.createDataFrame([(i, w, int(k)) for i, (w, k) in enumerate(zip(words, n))], "a int, word string, n long")
    pairs = information(write_shared(pair_counts(docs, "text", words)))
    sums = pairs.groupBy("a").agg(F.count("*").alias("partners"), F.sum("n").alias("near"), F.round(F.sum("ppmi"), 4).alias("information"))
    return named.join(F.broadcast(sums), "a").select("word", "n", "partners", "near", "information")


def learned_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ten nearest documents of those whose id is divisible by 100, the share in the same language, by learned and by hashed vectors."""
    docs = C._read(spark, sf_dir, "documents").filter("text is not null and lang is not null")
    out = None
    for name, embedder in (("learned", LearnedEmbedder.fit(docs)), ("hashed", HashedEmbedder(64))):
        vectors = write_shared(docs.select(F.col("doc_id").cast("string").alias("id"), "lang", embedder.column(F.col("text")).alias("vector")))
        asked = vectors.filter("cast(id as long) % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
        near = batch_top_k(vectors, asked, 64, 11).filter("query_id <> id")
        langs = vectors.select("id", "lang")
        both = near.join(langs, "id").join(langs.toDF("query_id", "own"), "query_id")
        one = both.agg(F.lit(name).alias("embedder"), F.countDistinct("query_id").alias("queries"), F.round(F.avg((F.col("lang") == F.col("own")).cast("int")), 4).alias("same_language"))
        out = one if out is None else out.union(one)
    return out


QUERIES |= {"word_information": word_information, "learned_purity": learned_purity}
ORACLES["word_information"] = r"""
WITH w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents)),
  v AS (SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 3 ORDER BY n DESC, word LIMIT 20000),
  k AS (SELECT * FROM w SEMI JOIN v USING (word)),
  p AS (SELECT a.word AS a, b.word AS b, count(*) AS n FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.i <> b.i AND abs(a.i - b.i) <= 5 GROUP BY ALL),
  s AS (SELECT a, sum(n) AS of FROM p GROUP BY a),
  t AS (SELECT sum(n) AS total FROM p)
SELECT v.word, v.n, count(*) AS partners, sum(p.n)::BIGINT AS near, round(sum(greatest(0.0, ln(p.n * total / (x.of::DOUBLE * y.of::DOUBLE)))), 4) AS information
FROM p JOIN v ON v.word = p.a JOIN s x ON x.a = p.a JOIN s y ON y.a = p.b, t GROUP BY v.word, v.n"""


# what is kept between runs -----------------------------------------------------------
def stored_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded in two runs: the even ones, then all. Per run its rows, the texts that were new, and the sum of the vectors' absolute numbers."""
    docs = C._read(spark, sf_dir, "documents").select("doc_id", "text")
    store = StoredEmbeddings(spark, kept_for_session(spark, "embedded"), HashedEmbedder())
    out = None
    for run, rows in (("half", docs.filter("doc_id % 2 = 0")), ("all", docs), ("again", docs)):
        new = store.add(rows, "text")
        found = store.vectors(rows, "text")
        one = found.agg(F.lit(run).alias("run"), F.count("*").alias("rows"), F.lit(new).cast("long").alias("embedded"), F.round(F.sum(norm_l1(F.col("vector"))), 3).alias("mass"))
        out = one if out is None else out.union(one)
    return out


def put_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of ``put_in_batches`` kept in a table with buckets."""
    source = Source(M.account, order="at")
    app = App(spark, [source], [M._account_index], now=C.NOW, buckets=8)
    rows = C._read(spark, sf_dir, "customer")
    for i in range(10):
        segment = F.when(F.lit(i % 2 == 0), F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(f"-{i}")))
        source.put(rows.filter(F.col("c_custkey") % (i + 1) == 0).select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") + i).alias("balance"), F.lit(None).cast("boolean").alias("rich"), segment.alias("segment"), F.lit(i).alias("at")))
    return C._rounded(app.query(Query(M._account_index).find(M.account).select(M.account.segment)).frame)


def clustered_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stored in the Z-order of brand, size and price, and counted under several filters."""
    path = kept_for_session(spark, "clustered") + "/rows"
    rows = C.app_of(spark, sf_dir, [C.part], _several).rows(_several, C.part)
    persist_clustered(rows, path, ["brand", "size", "price"])
    stored, out = restore(spark, path), None
    for name, where in (("size", C.part.size == 15), ("brand", C.part.brand.in_(["Brand#11", "Brand#13"])), ("sizes", (C.part.size > 45) | (C.part.size < 3)), ("type", C.part.type != "STANDARD")):
        plan = Query(_several).find(C.part).similar(_brand, "Brand#13").filter(where).bind({}, lambda *_: {}, C.NOW)
        one = plan.frame(stored).agg(F.lit(name).alias("filter"), F.count("*").alias("rows"), F.round(F.sum("score"), 4).alias("score"))
        out = one if out is None else out.union(one)
    return out


QUERIES |= {"stored_embeddings": stored_embeddings, "put_bucketed": put_bucketed, "clustered_filters": clustered_filters}
ORACLES["put_bucketed"] = ORACLES["put_in_batches"]
ORACLES["stored_embeddings"] = f"""
WITH w AS (SELECT doc_id, unnest({C._HASHED.format('text')}) AS w FROM documents),
  h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS b, CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT < 8 THEN 1.0 ELSE -1.0 END AS s FROM w),
  n AS (SELECT doc_id, b, sum(s) AS n FROM h GROUP BY ALL),
  m AS (SELECT doc_id, sum(abs(n)) / nullif(sqrt(sum(n * n)), 0) AS m FROM n GROUP BY doc_id),
  d AS (SELECT doc_id, text, coalesce(m, 0) AS m FROM documents LEFT JOIN m USING (doc_id))
SELECT 'half' AS run, count(*) AS rows, count(DISTINCT text) AS embedded, round(sum(m), 3) AS mass FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT 'all', count(*), (SELECT count(DISTINCT text) FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)), round(sum(m), 3) FROM d
UNION ALL SELECT 'again', count(*), 0, round(sum(m), 3) FROM d"""
ORACLES["clustered_filters"] = " UNION ALL ".join(
    f"SELECT '{name}' AS filter, count(*) AS rows, round(sum({C._marks('Brand#13')}), 4) AS score FROM {C.PART_SQL} t WHERE {where}"
    for name, where in (("size", "size = 15"), ("brand", "brand IN ('Brand#11', 'Brand#13')"), ("sizes", "size > 45 OR size < 3"), ("type", "type <> 'STANDARD'"))
)


# images ------------------------------------------------------------------------------
class Picture(Schema):
    key: IdField
    image: Blob


picture = Picture()


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a grey image of 8 by 8 pixels in binary PNM."""
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 256 + 128))))
    body = F.array_join(F.transform(grey, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return C._read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.unhex(F.concat(F.lit(b"P5 8 8 255\n".hex()), body)).alias("image"))


def image_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images at 4 by 4 pixels, through PNG."""
    small = pictures(spark, sf_dir).select("key", resize_blobs(F.col("image"), 4).alias("png"))

    @F.pandas_udf("string")
    def numbers(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: ",".join(map(str, decode_image(b).ravel().tolist())))

    return small.select(F.col("key").cast("string").alias("id"), numbers("png").alias("pixels"))


_image = ImageSpace(picture.image, GradientEmbedder())
_image_index = Index(_image)


def image_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images by the likeness of their gradients to the first one's."""
    app = App(spark, [source := Source(picture, unique=True)], [_image_index], now=C.NOW)
    source.put(pictures(spark, sf_dir))
    return C._rounded(app.query(Query(_image_index).find(picture).with_vector(picture, "0")).frame)


QUERIES |= {"image_resize": image_resize, "image_similar": image_similar}
ORACLES["image_resize"] = """
WITH g AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda x: greatest(0, least(255, floor(x::DOUBLE * 256 + 128)))) AS g FROM embeddings)
SELECT id, array_to_string(list_transform(range(16), lambda i: floor((g[16 * (i // 4) + 2 * (i % 4) + 1] + g[16 * (i // 4) + 2 * (i % 4) + 2] + g[16 * (i // 4) + 2 * (i % 4) + 9] + g[16 * (i // 4) + 2 * (i % 4) + 10]) / 4 + 0.5)::INT), ',') AS pixels FROM g"""


# results, storage, prompts, taps ---------------------------------------------------------
def table_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a table with their times as dates."""
    space = NumberSpace(C.order.total, 0, 400_000, Mode.MAXIMUM)
    index = Index(space, fields=[C.order.placed, C.order.status])
    query = Query(index).find(C.order).filter(C.order.status == "F").select(C.order.placed)
    table = C.app_of(spark, sf_dir, [C.order], index).query(query).to_table(("placed",))
    return table.withColumn("similarity_score", F.round("similarity_score", 6) + 0.0)


def half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items stored with 16-bit numbers: which of them keep every number to 0.0005, and whether files are smaller than half of those with 64 bits."""
    path = kept_for_session(spark, "half")
    rows = C.app_of(spark, sf_dir, [C.item], _index).rows(_index, C.item)
    persist(rows, f"{path}/half", half=True)
    persist(rows, f"{path}/whole")
    both = restore(spark, f"{path}/half").select("id", F.col("__raw_0").alias("h")).join(restore(spark, f"{path}/whole").select("id", F.col("__raw_0").alias("w")), "id")
    size = lambda name: stored_bytes(spark, f"{path}/{name}").select(F.col("bytes").alias(name))
    smaller = size("half").crossJoin(size("whole")).select((F.col("half") * 2 < F.col("whole")).alias("smaller"))
    near = F.forall(F.zip_with("h", "w", lambda a, b: F.abs(a - b) < 0.0005), lambda x: x)
    return both.select("id", near.alias("near")).crossJoin(F.broadcast(smaller))  # one row


def letters():
    """A model without weights: how often each letter from a to z occurs."""
    return lambda texts: np.array([[t.count(chr(97 + i)) for i in range(26)] for t in texts], float)


_prompted = TextSimilaritySpace(C.document.text, CachedEmbedder(26, letters, query_prompt="zz query: ", document_prompt="passage: "))
_prompted_index = Index(_prompted)
C.register("prompted_text", _prompted_index, Query(_prompted_index).find(C.document).similar(_prompted, "a question of letters"), None)


def stream_tee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a stream that goes into a store and, as it came, to a queue (two folders here): both, row by row."""
    path = kept_for_session(spark, "tee")
    schema = C._read(spark, sf_dir, "customer").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/customer.parque[t]")
    publish = lambda rows: rows.select(F.to_json(F.struct("c_custkey", "c_mktsegment")).alias("message")).write.mode("append").parquet(f"{path}/queue")
    sink = lambda rows, n: rows.select(F.col("c_custkey").alias("id"), "c_acctbal").write.mode("append").parquet(f"{path}/store")
    running = tee(stream, sink, publish, f"{path}/checkpoint")
    running.processAllAvailable()
    running.stop()
    messages = spark.read.parquet(f"{path}/queue").select(F.get_json_object("message", "$.c_custkey").cast("long").alias("id"), F.get_json_object("message", "$.c_mktsegment").alias("segment"))
    return spark.read.parquet(f"{path}/store").join(messages, "id").select("id", "segment", F.round(F.col("c_acctbal").cast("double"), 2).alias("balance"))


#: One event moves both sides: members toward the labels of things, things toward the levels of members.
_both = Index(M._level, effects=[Effect(M._level, M.visit.member, M.visit.thing, M.visit.what == "purchase"), Effect(M._level, M.visit.thing, M.visit.member, M.visit.what == "purchase")], temperature=0.5, event_influence=1.0)


def event_effects_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = M._visited(spark, sf_dir, _both, Query(_both).find(M.member).similar(M._level, 6.0))
    things = M._visited(spark, sf_dir, _both, Query(_both).find(M.thing).similar(M._level, 6.0))
    return members.select(F.lit("member").alias("side"), "id", "score").union(things.select(F.lit("thing"), "id", "score"))


QUERIES |= {"table_result": table_result, "half_precision": half_precision, "stream_tee": stream_tee, "event_effects_both": event_effects_both}
ORACLES["table_result"] = f"SELECT id, strftime(make_timestamp(placed * 1000000), '%Y-%m-%d %H:%M:%S') AS placed, round(CASE WHEN total < 0 THEN 0 ELSE sin({C._angle('total', 0.0, 400000.0)}) END, 6) + 0.0 AS similarity_score FROM {C.ORDER_SQL} WHERE status = 'F'"
ORACLES["half_precision"] = "SELECT CAST(vec_id AS VARCHAR) AS id, true AS near, true AS smaller FROM embeddings"
_count = lambda text: "[" + ", ".join(f"(len({text}) - len(replace({text}, '{chr(97 + i)}', '')))::DOUBLE" for i in range(26)) + "]"
ORACLES["prompted_text"] = f"""
WITH q AS (SELECT {_count("'zz query: a question of letters'")} AS q),
  d AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN coalesce(text, '') <> '' THEN {_count("('passage: ' || text)")} END AS v FROM documents)
SELECT id, round(coalesce(list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q)), 0), 6) + 0.0 AS score FROM d, q"""
ORACLES["stream_tee"] = "SELECT c_custkey AS id, c_mktsegment AS segment, round(c_acctbal::DOUBLE, 2) AS balance FROM customer"
ORACLES["event_effects_both"] = f"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
  e AS (SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN (user_id % 10)::DOUBLE END AS level, vec_id, label::DOUBLE AS label FROM events JOIN embeddings ON vec_id = event_id % (SELECT n FROM n) WHERE event_type = 'purchase'),
  m AS (SELECT u.user_id, coalesce(avg(label), any_value(CASE WHEN u.user_id % 3 <> 0 THEN (u.user_id % 10)::DOUBLE END)) AS y FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN e USING (user_id) GROUP BY u.user_id),
  t AS (SELECT v.vec_id, coalesce(avg(e.level), any_value(v.label::DOUBLE)) AS y FROM embeddings v LEFT JOIN e ON e.vec_id = v.vec_id GROUP BY v.vec_id),
  x AS (SELECT 'member' AS side, CAST(user_id AS VARCHAR) AS id, y FROM m UNION ALL SELECT 'thing', CAST(vec_id AS VARCHAR), y FROM t)
SELECT side, id, round(CASE WHEN y IS NULL THEN 0 ELSE cos({C._angle('y', 0.0, 10.0)} - {C._angle('6.0', 0.0, 10.0)}) END, 6) + 0.0 AS score FROM x"""


# plugged sources -----------------------------------------------------------------------
def plugged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations read through a plugged source that answers the conditions on turns and roles by itself."""
    asked = plugged(spark, "tesserine.sources.plugin:ArrowFiles", [Condition("role", "in", ["user", "assistant"]), Condition("turn", ">", 0)], path=f"{sf_dir}/conversations.parquet")
    return asked.groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.max("turn").alias("last"), F.sum(F.length("text")).alias("chars"))


QUERIES["plugged_source"] = plugged_source
ORACLES["plugged_source"] = "SELECT conv_id, role, count(*) AS turns, max(turn) AS last, sum(length(text))::BIGINT AS chars FROM conversations WHERE role IN ('user', 'assistant') AND turn > 0 GROUP BY conv_id, role"


# sentences -------------------------------------------------------------------------------
_priced, _branded = NumberSpace(C.part.price, 900, 1000, Mode.MINIMUM), CategoricalSimilaritySpace(C.part.brand, C.BRANDS)
_sentence_index = Index([_priced, _branded], fields=[C.part.type, C.part.size])
_sentence = (
    Query(_sentence_index, weights={_priced: Param("price_weight", default=1.0), _branded: 1.0}).find(C.part).similar(_branded, Param("brand", options=tuple(C.BRANDS)))
    .filter(C.part.size <= Param("max_size")).filter(C.part.size >= Param("min_size", default=1)).limit(Param("limit")).with_natural_query(Param("ask"), SlotFiller())
)
C.register("natural_slots", _sentence_index, _sentence, C._top(f"({C._marks('Brand#13')} - cos({C._angle('price', 900.0, 1000.0)})) / (sqrt(2.0) * sqrt(2.0))", C.PART_SQL, 60, "WHERE size BETWEEN 4 AND 30"), ask="sixty? no, the best 60 results of brand#13 with a size between 4 and 30; I dislike the price")
