"""The registered queries of the text operators: thin views of the operators' results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cdc, decontam, langid, packing, quality, rules, secret_scan, simhash, suffix
from .common import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's own and site evidence, combined score, toxicity and verdict, by models
    fitted on a bounded sample of ``labels``."""
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document's ids, its sequence of at most 2048 ids and its place there."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every document with the forest's score; secrets appear as digests only."""
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    return found.withColumn("value_sha256", F.sha2("value", 256)).drop("value")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that also start in a
    document with a smaller doc_id."""
    return suffix.dedup(read(spark, sf_dir, "documents"), keep_text=False).drop("removed")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE doc_id > least
), g AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span
  FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM r)
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span
), parts AS (
  SELECT s.doc_id, a, b, substring(h, CAST(2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1 AS BIGINT), CAST(2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0)) AS BIGINT)) AS before
  FROM spans s JOIN d ON d.doc_id = s.doc_id
), sums AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY a) AS front, max(b) AS last FROM parts GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(front, '') || substring(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model that has not seen the held-out fifth."""
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = langid.train(langid.training_rows(docs.where(~held)))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the chunks that came before, there or in itself."""
    return cdc.dedup(read(spark, sf_dir, "documents"), keep_text=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and whether it has more than 1024 of these."""
    counts = bpe.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 64-bit fingerprint and the smallest doc_id linked to it within two bits."""
    return simhash.report(read(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside occurrences of 13-word benchmark windows."""
    found = decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", decontam.items_digest().alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT m FROM bw
), dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)
), hits AS (
  SELECT doc_id, i, dw.m AS m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g
), n AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule statistics, the fixed rules' verdict and the forest's."""
    judged = rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", *rules.BASE, "base_failed", "kept", "anomaly")


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_classifier, op2_best_fit_packing, op3_secret_scans, op4_suffix_array_dedup, op5_language_id, op6_simhash_near_dedup, op7_benchmark_decontamination, op8_substring_dedup, op9_token_counts, op10_quality_rules)}


def oracle_sql() -> dict:
    return {"op4_suffix_array_dedup": OP4_SQL, "op7_benchmark_decontamination": OP7_SQL}
