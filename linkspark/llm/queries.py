"""The registered queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import conversation_digests
from .common import table
from .embedding_dedup import embedding_components
from .language_id import language_id
from .packing import pack
from .pieces import encode_documents
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .simhash import simhash_components
from .toxicity import toxicity
from .warc import warc_captures


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("spans")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), width=4, max_bits=4)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = warc_captures(table(spark, sf_dir, "pages"))
    digest = F.coalesce("capture.payload_digest", "capture.digest").alias("payload_digest")
    sides = [F.size(k).cast("long").alias(n) for k, n in (("request", "n_requests"), ("metadata", "n_metadata"))]
    return c.select("capture.page_id", "capture.payload_bytes", digest, F.col("capture.kind").alias("record_type"), F.col("capture.refers_page").alias("refers_to"), *sides)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), n=3)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("SELECT -7L AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    return conversation_digests(turns.unionByName(planted))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_warc": op2_warc,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_chat_formatting": op7_chat_formatting,
    "op4_quality_rules": op4_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op7_chat_formatting": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, length(role) + length(text) AS plain,
    2 * (length(role) + length(text)) - length(regexp_replace(role, '[][<\\\\]', '', 'g')) - length(regexp_replace(text, '[][<\\\\]', '', 'g')) - length(role) - length(text) AS marked
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(plain + marked + 11) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id""",
    "op2_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
  CAST(1 AS BIGINT) AS n_requests, CAST(1 AS BIGINT) AS n_metadata
FROM f""",
    # whole tables: at 10 labels the pairs of equal labels are few enough at sf0.01
    "op5_embedding_near_dedup": """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
low AS (SELECT u, min(v) AS v FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links,
  least(m.vec_id, coalesce(low.v, m.vec_id)) AS component_id,
  least(m.vec_id, coalesce(low.v, m.vec_id)) = m.vec_id AS kept
FROM embeddings m LEFT JOIN low ON m.vec_id = low.u LEFT JOIN n ON m.vec_id = n.u""",
}
