"""The queries of the training-data operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import chat_format, common, exact_dedup, license_scan, media, minhash_dedup, packing, sentencepieces, suffix_dedup, token_counts, toxicity


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_report(common.documents(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_report(common.documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_report(common.documents(spark, sf_dir))


def op4_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(common.documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.pieces_report(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(common.documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_minhash_near_dedup, op3_exact_dedup, op4_lossless_webp, op5_best_fit_packing,
        op6_sentencepiece, op7_chat_format, op8_license_scan, op9_toxicity, op10_token_counts,
    )
}

ORACLE = {
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY body)
    """,
    "op7_chat_format": r"""
        WITH t AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), p AS (
            SELECT conv_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
                   string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS prefix,
                   string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER w AS chat
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
        ), whole AS (
            SELECT min(conv_id) AS conv_id, n, prefix, min(chat) AS chat, count(*) AS n_copies FROM p WHERE k = n GROUP BY n, prefix
        )
        SELECT conv_id, n AS n_turns, n_copies, chat FROM whole
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = whole.n AND p.prefix = whole.prefix)
    """,
}
