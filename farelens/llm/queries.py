"""Registered queries of the corpus operators, with the settings of their contracts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from farelens.llm import (
    byte_bpe, conversations, exact_dedup, fingerprints, hard_negatives, line_dedup, mixing, ngram_join, quality, sharding, token_counts,
    toxicity, vectors,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), path)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_filter(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(_table(spark, sf_dir, "documents")).taken()


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.lower(F.sha2(F.col("_lines.kept"), 256)).alias("kept_sha256")
    return rows.select("doc_id", "_lines.n_lines", "_lines.n_dropped", kept)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), width=4, threshold=85)


def op8_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), 0.9)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.repair_conversations(conversations.damaged(rows), rows)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, over its whole table."""
    every = (
        op1_exact_dedup, op2_token_counts, op3_quality, op4_toxicity, op5_source_mixing, op6_line_dedup, op7_ngram_jaccard_join,
        op8_vector_near_dedup, op9_byte_bpe, op10_sharding, op11_conversation_repair, op12_fingerprints, op13_hard_negatives, pipeline,
    )
    return {query.__name__: query for query in every}


_SPACE = "[ \\t\\n\\x0B\\f\\r]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP1 = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM d
"""

_OP6 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key
  FROM l),
f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, coalesce(k.doc_id <> f.first_id, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP7 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.reached)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

_OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE list_aggregate(list_transform(embedding, lambda y: CASE WHEN y IS NULL OR NOT isfinite(y) THEN 1 ELSE 0 END), 'sum') = 0
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
e AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
b AS (SELECT u, w FROM e UNION ALL SELECT w, u FROM e),
r(vec_id, reached) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, b.w FROM r JOIN b ON b.u = r.reached),
n AS (SELECT u AS vec_id, count(*) AS n FROM b GROUP BY u)
SELECT vec_id, coalesce(any_value(n.n), 0) AS n_links, min(reached) AS component_id, vec_id = min(reached) AS kept
FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""

_OP10 = f"""
WITH h AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS m
  FROM documents),
r AS (SELECT doc_id, n_bytes, lpad(bin(('0x' || m[1:8])::UINTEGER), 32, '0') || lpad(bin(('0x' || m[9:16])::UINTEGER), 32, '0') AS bits FROM h),
e AS (SELECT substr(bits, 1, d) AS p, d, sum(n_bytes)::BIGINT AS s FROM r, range(0, 65) t(d) GROUP BY ALL),
c AS (
  SELECT x.p, x.d, x.s FROM e x LEFT JOIN e y ON y.d = x.d - 1 AND y.p = substr(x.p, 1, x.d - 1)
  WHERE x.s <= {sharding.LIMIT} AND (x.d = 0 OR y.s > {sharding.LIMIT}))
SELECT doc_id, n_bytes, p AS shard, d::INTEGER AS depth, s AS shard_bytes, s > {sharding.LIMIT} AS oversized
FROM r JOIN c ON starts_with(r.bits, c.p)
"""


_OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda y: floor(256 * y::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL can express; the others are tested against plain versions."""
    return {
        "op1_exact_dedup": _OP1,
        "op6_line_dedup": _OP6,
        "op7_ngram_jaccard_join": _OP7,
        "op8_vector_near_dedup": _OP8,
        "op10_sharding": _OP10,
        "op13_hard_negatives": _OP13,
    }
