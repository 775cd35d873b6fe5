"""Registered queries of this subpackage: each runs over the whole of its tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cairngraph.llm import bpe, chat, decontaminate, html, itq, langid, minhash, repeats, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op3_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_seen_and_blocked(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_groups(table(spark, sf_dir, "embeddings"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives_of_pages(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_bpe": op1_bpe,
        "op2_language_id": op2_language_id,
        "op3_chat_tool_calls": op3_chat_tool_calls,
        "op4_html_extraction": op4_html_extraction,
        "op5_url_filter": op5_url_filter,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_embedding_near_dedup": op7_embedding_near_dedup,
        "op8_warc_derivatives": op8_warc_derivatives,
        "op9_decontamination": op9_decontamination,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op3_chat_tool_calls": chat.oracle(), "op5_url_filter": urls.oracle(), "op8_warc_derivatives": warc.oracle()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
