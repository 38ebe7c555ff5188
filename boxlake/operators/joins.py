"""Joins that have a shape of their own: as-of, unseen entities, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_day


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], date: str, cols: Sequence[str], tiebreak: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Left rows with the newest right row of an earlier date (or the same one, if not strict).

    One exchange on ``by``: both sides are stacked and a range frame looks back.
    Rows without a date match nothing.
    """
    right = right.where(F.col(date).isNotNull())
    value = F.struct(epoch_day(date).alias("_d"), *dict.fromkeys((*tiebreak, *cols)))
    rest = [c for c in left.columns if c not in (*by, date)]
    a = left.select(*by, date, F.struct(*rest).alias("_left"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_right"))
    b = right.select(*by, date, F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), value.alias("_right"))
    before = Window.partitionBy(*by).orderBy(epoch_day(date)).rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    both = a.unionByName(b).withColumn("_found", F.when(F.col(date).isNotNull(), F.max("_right").over(before))).where(F.col("_left").isNotNull())
    return both.select(*by, date, *[F.col(f"_left.{c}").alias(c) for c in rest], *[F.col(f"_found.{c}").alias(f"asof_{c}") for c in cols])


def unseen_entities(train: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return other.select(key).distinct().join(train.select(key), key, "left_anti")


def seen_entities(train: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return other.select(key).distinct().join(train.select(key), key, "left_semi")


def tiered(df: DataFrame, tiers: Sequence[tuple[DataFrame, Sequence[str], str]], name: str) -> DataFrame:
    """First non-null of several lookups, with ``tier`` (from 1; null if none has a value)."""
    cols = []
    for i, (table, keys, value) in enumerate(tiers, 1):
        df = df.join(table.select(*keys, F.col(value).alias(f"_t{i}")), list(keys), "left")
        cols.append(f"_t{i}")
    tier = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(cols, 1)])
    return df.withColumns({name: F.coalesce(*cols), "tier": tier}).drop(*cols)
