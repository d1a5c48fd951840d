"""Queries of the corpus operators over their whole tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crosstok, decontam, hardneg, html, langid, linededup, lm, media, neardup, pii, quality, secrets

ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


ORACLES["op1_minhash_neardup"] = r"""
WITH RECURSIVE
  words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
  sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
    FROM words),
  shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
  links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  reach(doc_id, root) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.root) AS component_id, s.doc_id = min(r.root) AS kept
FROM sets s JOIN reach r ON r.doc_id = s.doc_id
GROUP BY s.doc_id, s.s
"""

#: Where the vocabulary lies; a parameter of the operator.
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), RANK_FILE, public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_predictions(_table(spark, sf_dir, "documents"))


def op4_spaced_seed_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Without seeds: all equal token pairs by alignment, then 11 of them within 13 positions.
ORACLES["op4_spaced_seed_decontam"] = r"""
WITH
  d AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos
        FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents)),
  i0 AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
  i AS (SELECT item_id, len(w) AS size, unnest(w) AS tok, generate_subscripts(w, 1) AS ipos FROM i0 WHERE len(w) >= 5),
  eq AS (SELECT doc_id, item_id, size, pos - ipos AS diag, list(ipos ORDER BY ipos) AS ix
         FROM d JOIN i USING (tok) GROUP BY doc_id, item_id, size, pos - ipos
         HAVING count(*) >= least(11, size)),
  best AS (
    SELECT doc_id, item_id,
      CASE WHEN size < 11 THEN size ELSE list_max([
        CASE WHEN ix[k + 12] - ix[k] <= 12 THEN 13 WHEN ix[k + 11] - ix[k] <= 12 THEN 12 WHEN ix[k + 10] - ix[k] <= 12 THEN 11 ELSE 0 END
        FOR k IN range(1, len(ix) + 1)]) END AS best
    FROM eq),
  per AS (SELECT doc_id, item_id, max(best) AS best FROM best WHERE best > 0 GROUP BY ALL),
  flat AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(best) AS best FROM per GROUP BY doc_id)
SELECT documents.doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0) AS n_items, coalesce(items, '') AS items, coalesce(best, 0)::BIGINT AS best
FROM documents LEFT JOIN flat USING (doc_id)
"""


def op5_context_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.ctw_scores(_table(spark, sf_dir, "documents"))


def op6_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(_table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_table(spark, sf_dir, "pages"))


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(_table(spark, sf_dir, "documents"))


ORACLES["op11_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
  k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 100 == 0)


ORACLES["op13_hard_negatives"] = r"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT a, b AS positive, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
  n AS (
    SELECT p.a AS anchor_id, p.positive AS positive_id, row_number() OVER (PARTITION BY p.a, p.positive ORDER BY s.score DESC, s.b) AS r, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10
"""


# What the contracts fix exactly, taken from the operators' own results and held against SQL --------------------------
def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Documents with each match of a pattern between two control characters, cut there: (doc_id, match, start, end) in code points.
def _matches(pattern: str) -> str:
    return rf"""
  SELECT doc_id, m, start, start + len(m) AS stop FROM (
    SELECT doc_id, i, string_split(seg, chr(2))[1] AS m, (sum(len(seg) - (i > 1)::INT) OVER (PARTITION BY doc_id ORDER BY i) - len(seg) + (i > 1)::INT)::BIGINT AS start FROM (
      SELECT doc_id, unnest(s) AS seg, generate_subscripts(s, 1) AS i
      FROM (SELECT doc_id, string_split(regexp_replace(t, '{pattern}', chr(1) || '\0' || chr(2), 'g'), chr(1)) AS s FROM d))) WHERE i > 1"""


_ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + """)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_TEXTS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _digest(kinds: tuple[str, ...], order: str) -> str:
    counts = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)
    sums = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(kinds))
    names = str(list(kinds))
    return f"""
SELECT doc_id, {counts}, sha256(coalesce(line, '')) AS base_sha256 FROM documents
LEFT JOIN (SELECT doc_id, {sums}, string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY {order}) AS line FROM spans GROUP BY doc_id) USING (doc_id)"""


def exact_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


ORACLES["exact_secret_spans"] = f"""
WITH {_TEXTS}, spans AS (
  SELECT 0 AS kind, * FROM ({_matches(_ASSIGN)}) WHERE len(regexp_extract(m, '{_ASSIGN}', 2)) >= 6
  UNION ALL SELECT 1, * FROM ({_matches('AKIA[A-Z0-9]+')}) WHERE len(m) >= 20
  UNION ALL SELECT 2, * FROM ({_matches('[0-9a-f]+')}) WHERE len(m) >= 24)
{_digest(('assign', 'access', 'hex'), 'start, kind')}"""


def exact_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_boosted_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


_LUHN = "list_sum(list_transform(range(1, len(g) + 1), lambda i: ((substr(reverse(g), i, 1)::INT * (2 - i % 2)) // 10) + ((substr(reverse(g), i, 1)::INT * (2 - i % 2)) % 10))) % 10 = 0"
ORACLES["exact_pii_spans"] = f"""
WITH {_TEXTS}, spans AS (
  SELECT 0 AS kind, * FROM ({_matches('[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+')})
  UNION ALL SELECT 1, * FROM ({_matches('[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)')}) WHERE len(list_filter(string_split(m, '.'), lambda x: x::DOUBLE > 255)) = 0
  UNION ALL SELECT 2, doc_id, m, start, stop FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS g FROM ({_matches('[0-9]([ -]?[0-9])+')})) WHERE len(g) BETWEEN 13 AND 19 AND {_LUHN}
  UNION ALL SELECT 3, * FROM ({_matches('[+][0-9][ ().0-9-]+[0-9]')}) WHERE len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)
{_digest(('email', 'ip', 'card', 'phone'), 'kind, start')}"""

#: CRC-32 of a list of bytes, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], {0}), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295::BIGINT)"


def exact_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_context_tree_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


ORACLES["exact_word_scores"] = rf"""
WITH h AS (SELECT doc_id, {_CRC.format("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 10 = 0 AS held_out,
    list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), [' end']) AS w FROM documents),
  x AS (SELECT doc_id, held_out, unnest(w) AS w FROM h),
  c AS (SELECT w, count(*) AS c FROM x WHERE NOT held_out GROUP BY w),
  n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 4) AS base_score
FROM x LEFT JOIN c USING (w), n GROUP BY doc_id, held_out, n"""


def exact_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")


_LITTLE = "format('{{:02X}}{{:02X}}{{:02X}}{{:02X}}', ({0}) & 255, (({0}) >> 8) & 255, (({0}) >> 16) & 255, (({0}) >> 24) & 255)"
ORACLES["exact_media"] = f"""
WITH a AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, coalesce(text, '') AS t FROM documents),
  b AS (SELECT doc_id, n, greatest(64, (n + 63) // 64 * 64) AS p, encode(t || repeat(chr(0), (greatest(64, (n + 63) // 64 * 64) - n)::INT)) AS payload FROM a),
  c AS (SELECT *, hex(payload)[-128:] AS tail, from_hex('52494646' || {_LITTLE.format('36 + p')} || '57415645666D742010000000010001' || '00401F0000401F00000100080064617461' || {_LITTLE.format('p')}) AS head FROM b)
SELECT doc_id, n AS n_bytes, p AS payload_bytes, sha256(payload) AS payload_sha256,
  {_CRC.format("list_transform(regexp_extract_all(tail, '..'), lambda x: ('0x' || x)::BIGINT)")} AS tail_crc32, 44 + p AS media_bytes, sha256(head || payload) AS media_sha256 FROM c"""


QUERIES = {
    "op1_minhash_neardup": op1_minhash_neardup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language_id": op3_language_id,
    "op4_spaced_seed_decontam": op4_spaced_seed_decontam,
    "op5_context_tree_lm": op5_context_tree_lm,
    "op6_boosted_pii": op6_boosted_pii,
    "op7_secret_scan": op7_secret_scan,
    "op8_media_columns": op8_media_columns,
    "op9_html_layout": op9_html_layout,
    "op10_weak_quality": op10_weak_quality,
    "op11_line_dedup": op11_line_dedup,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op13_hard_negatives": op13_hard_negatives,
    "exact_secret_spans": exact_secret_spans,
    "exact_pii_spans": exact_pii_spans,
    "exact_word_scores": exact_word_scores,
    "exact_media": exact_media,
}
