"""Constraint checks: violations by row, quarantine, rates by unit."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import COUNTS


def _any(conditions: Iterable[Column]) -> Column:
    """Whether one is true; false without any. Plain expressions, which Spark compiles, unlike functions over arrays."""
    return reduce(Column.__or__, conditions, F.lit(False))


def box_checks(counts: Sequence[str] = COUNTS, minutes: str = "minutes", dnp: str | None = "dnp", points: bool = False) -> dict[str, Column]:
    """Name -> condition that is true for a violation; null values violate nothing."""
    c = F.col
    checks = {
        "fgm_le_fga": c("fgm") > c("fga"), "tpm_le_tpa": c("tpm") > c("tpa"), "ftm_le_fta": c("ftm") > c("fta"), "tpm_le_fgm": c("tpm") > c("fgm"), "tpa_le_fga": c("tpa") > c("fga"),
        "reb_sum": c("oreb") + c("dreb") != c("reb"), "non_negative": F.least(*counts, minutes) < 0,
        "integral": _any(c(n).cast("double") % 1 != 0 for n in counts)}
    if dnp:
        checks["dnp_minutes"] = c(dnp) != (c(minutes) == 0)
    if points:
        checks["pts_sum"] = 2 * c("fgm") + c("tpm") + c("ftm") != c("pts")
    return checks


def team_checks(counts: Sequence[str] = COUNTS, minutes: str = "minutes", points: bool = False) -> dict[str, Column]:
    """The checks of team rows: those of player rows but for absence."""
    return box_checks(counts, minutes, None, points)


def absence_checks(dnp: str = "dnp", minutes: str = "minutes") -> dict[str, Column]:
    """Players who did not play have no minutes."""
    return {"absent_minutes": F.col(dnp) & (F.col(minutes) != 0)}


def with_violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Adds ``violations``, the names of the checks that a row fails."""
    none = F.array().cast("array<string>")
    return df.withColumn("violations", F.concat(none, *[F.when(bad, F.array(F.lit(name))).otherwise(none) for name, bad in checks.items()]))


def validate(df: DataFrame, checks: Mapping[str, Column], mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); ``mode="fail"`` raises on the first reject."""
    # A generator's output, as conditions on it are not pushed below: there, every check would repeat the expressions behind its columns.
    marked = df.select("*", F.explode(F.array(_any(F.coalesce(bad, F.lit(False)) for bad in checks.values()))).alias("_failed"))
    rejected = with_violations(marked.where("_failed").drop("_failed"), checks)
    if mode == "fail" and (first := rejected.select("violations").first()) is not None:
        raise ValueError(f"constraint violated: {', '.join(first.violations)}")
    return marked.where(~F.col("_failed")).drop("_failed"), rejected


def constraint_violation_rate(df: DataFrame, checks: Mapping[str, Column], unit: Sequence[str]) -> DataFrame:
    """By check and for ``any``: units, units with a violation, rate."""
    names = list(checks)
    by_unit = df.groupBy(*unit).agg(*[F.max(F.coalesce(bad, F.lit(False)).cast("int")).alias(n) for n, bad in checks.items()])
    flags = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("bad")) for n in names], F.struct(F.lit("any").alias("check"), F.greatest(*names, F.lit(0)).alias("bad")))
    return by_unit.select(F.inline(flags)).groupBy("check").agg(F.count("*").alias("units"), F.sum("bad").alias("bad_units"), F.avg("bad").alias("rate"))


def minutes_sum(df: DataFrame, keys: Sequence[str], minutes: str, total: float, tol: float) -> DataFrame:
    """Groups and whether their minutes add up."""
    return df.groupBy(*keys).agg(F.sum(minutes).alias("total")).withColumn("ok", F.abs(F.col("total") - total) <= tol)


def team_totals_match(players: DataFrame, teams: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Team rows and the names of the stats in which they differ from their players' sum."""
    sums = players.groupBy(*keys).agg(*[F.sum(c).alias(f"_s_{c}") for c in cols])
    joined = teams.join(sums, list(keys), "left")
    return with_violations(joined, {c: ~F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in cols}).select(*keys, "violations")
