"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thinned(rows: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each value of ``label``, and the values' counts.

    Which rows they are depends on a hash of doc_id alone; rows of a less
    frequent value are all kept. Rows are thinned out where they lie, before
    any of them meet.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0), counts
    share = rows.sparkSession.createDataFrame([(v, per_class / n) for v, n in counts.items()], f"{label} {rows.schema[label].dataType.simpleString()}, _share double")
    kept = rows.join(F.broadcast(share), label).where(F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5 < F.col("_share"))
    return kept.drop("_share"), counts
