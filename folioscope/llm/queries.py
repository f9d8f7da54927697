"""Queries over the training-data tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import chat, decontaminate, language, licenses, neardup, packing, pages, secrets, substrings, topk
from folioscope.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.report(table(spark, sf_dir, "pages"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(table(spark, sf_dir, "embeddings"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark, table(spark, sf_dir, "conversations"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op2, which SQL can express."""
    return op2_secrets(spark, sf_dir).drop("spans")


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op6, which SQL can express."""
    return op6_licenses(spark, sf_dir).drop("labels", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_secrets,
        op3_neardup,
        op4_pages,
        op5_substrings,
        op6_licenses,
        op7_language,
        op8_topk,
        op9_chat,
        op10_packing,
        secrets_base,
        licenses_base,
    )
}
