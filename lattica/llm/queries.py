"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontam, edit_fingerprint, packing, pii, quality, secret_scan, spans, token_blocks, url_filter, warc
from .near_dup import near_duplicates
from .workspace import Workspace

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, similarity=0.8)


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Workspace(spark, "token-blocks").path("files")
    token_blocks.write_token_blocks(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), "words", 1)
    return token_blocks.read_token_blocks(spark, folder, with_ids=False)


def op3_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*secret_scan.BASE_KINDS, "random")]
    return found.select("doc_id", *counts, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("found")).alias("spans"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "spaces", 2)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone", "iban", "ssn")]
    base = F.filter("found", lambda x: ~x["kind"].isin("iban", "ssn"))
    return found.select("doc_id", *counts, F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(F.col("found")).alias("spans"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.withColumn("block", F.col("block").cast("string"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_token_blocks, op3_edit_fingerprints, op4_secrets, op5_url_rules, op6_packing, op7_decontamination, op8_quality, op9_personal_data, op10_warc_derivatives,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
_FITS = " UNION ALL ".join(f"SELECT page_id, host, path, '{h}{p}' AS rule, '{v}' AS verdict FROM u WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, v in RULES)
ORACLES = {
    "op5_url_rules": rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), fits AS ({_FITS}), best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k FROM fits
)
SELECT u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM u LEFT JOIN best ON u.page_id = best.page_id AND k = 1
""",
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
