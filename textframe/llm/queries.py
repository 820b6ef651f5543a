"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textframe.llm import decontaminate, fingerprint, language, pieces, repeats, secrets, simhash, toxicity, urls, warc
from textframe.llm._common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1."""
    return fingerprint.texts(table(spark, sf_dir, "documents"))


def base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7."""
    return secrets.base(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_fingerprints, op2_language, op3_toxicity, op4_decontaminate, op5_repeats, op6_pieces, op7_secrets, op8_simhash, op9_warc, op10_urls, edited_texts, base_spans)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": decontaminate.SQL,
        "op5_repeats": repeats.SQL,
        "op9_warc": warc.SQL,
        "op10_urls": urls.SQL,
        "edited_texts": fingerprint.TEXTS_SQL,
        "base_spans": secrets.BASE_SQL,
    }
