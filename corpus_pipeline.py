"""Corpus preparation in stages over ``documents``, each written as Parquet and reread by the next.

Order: language identification drops what it cannot tell, MinHash near-dedup keeps one document of
each group, decontamination drops documents with benchmark passages, the secret scan masks
secrets, and the tokenizer turns the rest into token digests. Every stage works on all rows that
its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import bpe, decontam, langid, neardup, secrets
from tesserine.llm.textops import bounded, shared_folder, write_shared

#: Least score with which a recognised language is kept.
LANGUAGE_SCORE = 0.4
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs), LANGUAGE_SCORE)


def spare(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: the one with the smallest id.

    Rows without an id take part under a number above all ids that their text gives them, so that a
    row with an id goes before its copies without one. Of rows with one id and one text one stays.
    """
    key = spare(docs, "_key")
    made = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 61))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), made))
    dropped = neardup.near_duplicates(keyed.select(key, "text"), words=5, percent=80, id_col=key).filter("not kept").select(key).distinct()
    repeated = write_shared(keyed.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key))
    left = keyed.join(bounded(write_shared(dropped)), key, "left_anti")
    if not repeated.isEmpty():
        again = bounded(repeated)
        left = left.join(again, key, "left_anti").union(left.join(again, key, "left_semi").dropDuplicates([key, "text"]))
    return left.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows with a passage; a row is known by its id and its text, so that others of its id (or without one) stay."""
    key = spare(docs, "_key")
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string"))
    keyed = docs.withColumn(key, named)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontam.passage_hits(keyed, benchmark, id_col=key).select(F.col("doc").alias(key)).distinct()
    return keyed.join(bounded(write_shared(hit)), key, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, RANK_FILE, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("byte_bpe", tokenize),
]

#: The language model and the tokenizer are not SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with what each kept written to the session's shared folder until the next is written."""
    base, at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", spark._jvm.org.apache.hadoop.fs.Path
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = at(base).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at(base))
    files.deleteOnExit(at(base))  # the last stage's rows are read after this returns
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            files.delete(at(f"{base}/{i - 1}_{STAGES[i - 1][0]}"), True)
    return docs
