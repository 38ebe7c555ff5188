"""Corpus pipeline: five of the ten operators, one after another.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.llm.bpe import bpe_round_trip
from boxlake.llm.common import prepare, read, remove_dir, shared_dir, tokenizer
from boxlake.llm.decontaminate import without_leaks
from boxlake.llm.line_templates import drop_recurring_lines
from boxlake.llm.near_copies import one_of_each
from boxlake.llm.quality import THRESHOLD, fit_quality, quality_score


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the stage's own input, accepts, with all their columns.

    Null and empty texts are scored like any other (the curve's value for no
    evidence), very long ones whole. Repeated rows go or stay together; empty tables stay empty.
    """
    prepare(spark)
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return docs.where(quality_score(F.col("text"), model) >= THRESHOLD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; n_chars, if there, follows the text.

    Null texts stay null, with a null n_chars, and a text that loses all its
    lines stays as an empty one. Very long texts are parsed whole. All rows and
    columns are kept; empty tables stay empty.
    """
    cut = drop_recurring_lines(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id, with all its columns.

    Texts without words, null ones included, are one group. A row without
    doc_id stays, and rows that repeat doc_id and text stay or go together. Very
    long texts are compared by all their shingles; empty tables stay empty.
    """
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, with all their columns.

    Null and empty texts contain none, very long ones are searched whole.
    Repeated rows stay or go together; with an empty table on either side all stay.
    """
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each row; null texts count as empty ones."""
    return bpe_round_trip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("bpe", encode),
]

#: The classifier has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote is deleted once the next one has written. The last one's input stays."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            remove_dir(spark, before)
        before = out
    return STAGES[-1][1](spark, docs, sf_dir)
