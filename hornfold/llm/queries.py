"""The registered queries of the operators and their SQL: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hornfold.llm import (
    chat,
    exact_dedup,
    html_text,
    line_templates,
    mixing,
    packing,
    quality,
    repair,
    sharding,
    simhash,
    sketches,
    spelling,
    token_files,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_templates.drop_recurring(documents(spark, sf_dir))
    return kept.select(
        "doc_id",
        "n_lines",
        "dropped_lines",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.store(documents(spark, sf_dir), null_ids=True)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(conversations(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt by conversation once: its parts and its digests both find it there.
    rows = chat.with_probe(conversations(spark, sf_dir)).repartition("conv_id")
    return chat.read_back(chat.formatted(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_packing, op2_exact_dedup, op3_sharding, op4_line_templates, op5_quality, op6_html_text, op7_sketches,
        op8_token_files, op9_simhash, op10_mixing, op11_repair, op12_spelling, op13_chat,
    ]
    return {**{f.__name__: f for f in found}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": r"""
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))
                AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM n WINDOW w AS (PARTITION BY text_sha256)""",
        "op13_chat": r"""
            WITH c AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
            e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id, floor(turn / 64) ORDER BY turn NULLS FIRST, role, text) AS before,
                length(replace(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '<turn>', '<\turn>'), '</turn>', '<\/turn>')) AS t,
                length(replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '<turn>', '<\turn>'), '</turn>', '<\/turn>')) AS r
                FROM c)
            SELECT conv_id, count(*) AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                sum(13 + t + CASE WHEN before = role THEN 0 ELSE 7 + r END)::BIGINT AS formatted_chars
            FROM e GROUP BY conv_id""",
    }
