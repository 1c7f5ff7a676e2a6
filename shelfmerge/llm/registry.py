"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmerge.llm import (
    align,
    chat_format,
    decontaminate,
    extract_text,
    knn_join,
    language,
    line_dedup,
    link_graph,
    mixing,
    oracles,
    packing,
    ranked,
    simhash,
    warc,
)
from shelfmerge.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_report(spark, table(spark, sf_dir, "conversations"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(table(spark, sf_dir, "pages"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text.extract_main_text(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op5_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.knn_join(table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.url_verdicts(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(spark, table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_report(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = [
    op1_chat_format,
    op2_warc,
    op3_html_extraction,
    op4_simhash,
    op5_knn_join,
    op6_url_filter,
    op7_packing,
    op8_decontamination,
    op9_line_dedup,
    op10_language,
    op11_mixing,
    op12_alignment,
    op13_ranked_search,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """The others are held against brute force or held-out labels in tests/llm."""
    return oracles.oracle_sql()
