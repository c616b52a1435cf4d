"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortrank.llm import bpe, flat_graph, jaccard_join, line_templates, packing, prefix_forest, quality_model, quality_rules, resampling, sharding, token_counts, value_dictionaries, warc
from cohortrank.llm.common import read_table

SHARDS, SEQUENCE, END_ID = 24, 4096, 1


def byte_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = byte_ranks(), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(read_table(spark, sf_dir, "documents"), path, pattern)
    decoded = bpe.decode_documents(encoded, path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many were dropped, and a checksum of the text that is left."""
    out = line_templates.drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), report=True, short=True)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.octet_length("text").alias("text_bytes"), F.crc32("text").alias("text_crc32"))


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack_documents(read_table(spark, sf_dir, "documents"), path, SEQUENCE, END_ID)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read_table(spark, sf_dir, "documents"), copies="each")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), byte_ranks(), public_tokenizers.PATTERN)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_model.score_documents(docs, quality_model.learn(docs, read_table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op10_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.search(read_table(spark, sf_dir, "embeddings"))


def op11_regular_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_graph.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op13_value_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_dictionaries.compress(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_byte_bpe, op2_line_templates, op3_byte_shards, op4_best_fit_packing, op5_line_frequency, op6_token_counts, op7_jaccard_join, op8_bradley_terry, op9_warc, op10_prefix_forest, op11_regular_sampling, op12_flat_graph, op13_value_dictionaries)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": OP9_SQL, "op11_regular_sampling": OP11_SQL, "op13_value_dictionaries": OP13_SQL}


#: What the archives must give back.
OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(octet_length(encode(html)), 0) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to,
       true AS intact
FROM m
"""

#: CRC-32 goes bit by bit: a byte is mixed in, then eight steps (-1) divide by the polynomial.
OP11_SQL = r"""
WITH f AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), w AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(octet_length(encode(word))), lambda i: [CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM f)
), n AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t, sum(count(*) FILTER (side = 0)) OVER () AS all_s, sum(count(*) FILTER (side = 1)) OVER () AS all_t
  FROM f JOIN w USING (word) GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (all_s::DOUBLE + 10000) / ((s + 1.0::DOUBLE) * (all_t::DOUBLE + 10000)))) AS BIGINT) AS gain FROM n
), d AS (
  SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN w USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id
), e AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN d USING (doc_id)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS total FROM e
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= total * 10 // 100 THEN place END AS rank FROM r
"""

#: A distance and its entry are one number, so that the least has the lower index at a tie.
OP13_SQL = """
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, part, list_slice(v, part * 4 + 1, part * 4 + 4) AS x FROM k, (SELECT unnest(range(16)) AS part)
), b0 AS (
  SELECT part, e, x AS y FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64) USING (vec_id)
), a0 AS (
  SELECT vec_id, part, x, min(((x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2 + (x[4] - y[4]) ** 2)::BIGINT * 64 + e) AS m FROM p JOIN b0 USING (part) GROUP BY ALL
), b1 AS (
  SELECT b0.part, b0.e, coalesce(n.y, b0.y) AS y FROM b0 LEFT JOIN (
    SELECT part, m % 64 AS e, [CAST(floor(avg(x[1])) AS BIGINT), CAST(floor(avg(x[2])) AS BIGINT), CAST(floor(avg(x[3])) AS BIGINT), CAST(floor(avg(x[4])) AS BIGINT)] AS y FROM a0 GROUP BY ALL) n USING (part, e)
), a1 AS (
  SELECT vec_id, part, x, min(((x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2 + (x[4] - y[4]) ** 2)::BIGINT * 64 + e) AS m FROM p JOIN b1 USING (part) GROUP BY ALL
), b2 AS (
  SELECT b1.part, b1.e, coalesce(n.y, b1.y) AS y FROM b1 LEFT JOIN (
    SELECT part, m % 64 AS e, [CAST(floor(avg(x[1])) AS BIGINT), CAST(floor(avg(x[2])) AS BIGINT), CAST(floor(avg(x[3])) AS BIGINT), CAST(floor(avg(x[4])) AS BIGINT)] AS y FROM a1 GROUP BY ALL) n USING (part, e)
), a2 AS (
  SELECT vec_id, part, min(((x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2 + (x[4] - y[4]) ** 2)::BIGINT * 64 + e) AS m FROM p JOIN b2 USING (part) GROUP BY vec_id, part, x
), c AS (
  SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256
FROM c JOIN (SELECT vec_id, label FROM k) USING (vec_id)
"""
