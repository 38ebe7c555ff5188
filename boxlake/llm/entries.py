"""Queries of the numbered operators; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fill_in_middle, filter_audit, line_templates, topk
from .common import read, tokenizer


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest, secret_scan

    return digest(secret_scan(read(spark, sf_dir, "documents")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_round_trip

    return bpe_round_trip(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import digest, substring_dedup

    return digest(substring_dedup(read(spark, sf_dir, "documents")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_output

    return token_output(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_dedup

    return simhash_dedup(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, fit_quality

    docs = read(spark, sf_dir, "documents")
    return classify(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit_language, identify

    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit_language(docs))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import QUERY_STEP, top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_templates import digest, drop_recurring_lines

    return digest(drop_recurring_lines(read(spark, sf_dir, "documents")))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import extract

    return extract(read(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


ORACLE_SQL: dict[str, str] = {
    "op8_topk": topk.ORACLE_SQL,
    "op9_decontaminate": decontaminate.ORACLE_SQL,
    "op10_line_templates": line_templates.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
