"""Features of the past: only rows of strictly earlier dates count.

Windows count games played, not days. Two rows of one date never see each
other, and rows that were not played get features but give none. A row
without a date has no past and is nobody's past.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clipped, epoch_day

_BEFORE = (Window.unboundedPreceding, -1)


def counts(date: str, played: Column | None) -> Column:
    """Whether a row is part of the past of later ones."""
    return F.col(date).isNotNull() & (F.lit(True) if played is None else F.coalesce(played, F.lit(False)))


def trailing_sums(df: DataFrame, entity: Sequence[str], date: str, tiebreak: Sequence[str], sums: Mapping[str, Column], windows: Sequence[int], played: Column | None = None) -> DataFrame:
    """Adds ``_state``: for played rows the sums over the last N played rows, this one included."""
    df = df.repartition(*entity)  # both windows below then share one exchange
    values = {f"_v_{k}": c for k, c in sums.items()}
    df = df.withColumns({"_played": counts(date, played), "_day": epoch_day(date), **values})
    own = Window.partitionBy(*entity, "_played").orderBy(date, *tiebreak)
    fields = [F.col("_day"), *map(F.col, tiebreak), F.col(date).alias("_date")]
    for n in windows:
        frame = own.rowsBetween(-(n - 1), 0)
        fields.append(F.count(F.lit(1)).over(frame).alias(f"n_{n}"))
        fields += [F.sum(v).over(frame).alias(f"{v[3:]}_sum_{n}") for v in values]
    return df.withColumn("_state", F.when(F.col("_played"), F.struct(*fields))).drop(*values)


def prior_rolling(df: DataFrame, entity: Sequence[str], date: str, tiebreak: Sequence[str], sums: Mapping[str, Column], windows: Sequence[int], played: Column | None = None, keep_date: bool = False, reset_by: Sequence[str] = ()) -> DataFrame:
    """Adds ``n_N`` and ``<name>_sum_N`` over the last N played rows of an earlier date, null without any.

    Windows reach over seasons; with ``reset_by`` they start anew in each of its values.

    The newest earlier state is the greatest struct, whose leading fields are
    the day and the tiebreak, so the result does not depend on row order.
    """
    entity = [*entity, *reset_by]
    marked = trailing_sums(df, entity, date, tiebreak, sums, windows, played)
    before = Window.partitionBy(*entity).orderBy("_day").rangeBetween(*_BEFORE)
    prior = marked.withColumn("_prior", F.when(F.col("_day").isNotNull(), F.max("_state").over(before)))
    names = [f"n_{n}" for n in windows] + [f"{k}_sum_{n}" for n in windows for k in sums]
    out = {name: F.coalesce(f"_prior.{name}", F.lit(0)) if name.startswith("n_") else F.col(f"_prior.{name}") for name in names}
    if keep_date:
        out["last_contributing"] = F.col("_prior._date")
    return prior.withColumns(out).drop("_state", "_prior", "_played", "_day")


def means(names: Sequence[str], windows: Sequence[int], prefix: str = "") -> list[Column]:
    """Means from the sums of :func:`prior_rolling`; fewer than N games average what is there."""
    return [F.try_divide(F.col(f"{k}_sum_{n}").cast("double"), F.col(f"n_{n}")).alias(f"{prefix}{k}_avg_{n}") for k in names for n in windows]


def rates(names: Sequence[str], per: str, windows: Sequence[int], prefix: str = "", scale: float = 1.0) -> list[Column]:
    """Ratio of sums; null where the denominator is zero."""
    return [F.try_divide(F.col(f"{k}_sum_{n}").cast("double") * scale, F.col(f"{per}_sum_{n}")).alias(f"{prefix}{k}_per_{per}_{n}") for k in names for n in windows]


def season_to_date(df: DataFrame, entity: Sequence[str], season: str, date: str, stats: Sequence[str], played: Column | None = None) -> DataFrame:
    """Adds ``std_n`` and ``std_<stat>``, sums over earlier played games of the season."""
    before = Window.partitionBy(*entity, season).orderBy(epoch_day(date)).rangeBetween(*_BEFORE)
    on, dated = counts(date, played), F.col(date).isNotNull()
    sums = {f"std_{s}": F.when(dated, F.sum(F.when(on, F.col(s))).over(before)) for s in stats}
    return df.withColumns({"std_n": F.when(dated, F.count_if(on).over(before)).otherwise(F.lit(0)), **sums})


def days_since_last(df: DataFrame, entity: Sequence[str], date: str, cap: int | None = 30, played: Column | None = None, name: str = "days_since_last") -> DataFrame:
    day = epoch_day(date)
    before = Window.partitionBy(*entity).orderBy(day).rangeBetween(*_BEFORE)
    gap = day - F.max(day if played is None else F.when(played, day)).over(before)
    return df.withColumn(name, gap if cap is None else clipped(gap, 0, cap))


def season_role(minutes: Column, starter: float = 24.0, rotation: float = 10.0) -> Column:
    """Role by mean minutes of the last ten games."""
    return F.when(minutes >= starter, "starter").when(minutes >= rotation, "rotation").when(minutes > 0, "end_of_bench").otherwise("inactive")


def leaks_of(df: DataFrame, date: str, last: str = "last_contributing") -> DataFrame:
    """Rows to which a date not strictly earlier contributed; to a row without a date none is."""
    return df.where((F.col(last) >= F.col(date)) | (F.col(date).isNull() & F.col(last).isNotNull()))


def assert_no_future(df: DataFrame, date: str, last: str = "last_contributing") -> None:
    if (row := leaks_of(df, date, last).first()) is not None:
        raise AssertionError(f"a later row contributes: {row.asDict()}")
