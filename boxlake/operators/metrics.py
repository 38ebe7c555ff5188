"""Errors, coverage, reliability, comparisons and ensemble summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.raw import same_keys
from .sketches import KLL_K, quantile_sketches, quantiles


def paired(actual: DataFrame, predicted: DataFrame, keys: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Long rows (keys, stat, y, p) of cells that both sides have."""
    p = predicted.select(*keys, *[F.col(s).alias(f"_p_{s}") for s in stats])
    cells = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("y"), F.col(f"_p_{s}").cast("double").alias("p")) for s in stats])
    return actual.join(p, list(keys)).select(*keys, F.inline(cells)).where(F.col("y").isNotNull() & F.col("p").isNotNull())


def cells_of(df: DataFrame, keys: Sequence[str], pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The rows of :func:`paired` where outcome and prediction stand in one row; ``pairs`` maps a stat to both columns."""
    cells = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")) for s, (y, p) in pairs.items()])
    return df.select(*keys, F.inline(cells)).where(F.col("y").isNotNull() & F.col("p").isNotNull())


def per_stat_error(cells: DataFrame) -> DataFrame:
    d = F.col("y") - F.col("p")
    return cells.groupBy("stat").agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count("*").alias("n"))


def interval_coverage(df: DataFrame, y: str, low: str, high: str, target: float = 0.8) -> DataFrame:
    """Share of y within [low, high], both ends included, and whether it meets the target."""
    inside = F.avg(F.col(y).between(F.col(low), F.col(high)).cast("int"))
    return df.agg(inside.alias("coverage"), F.count(y).alias("n")).withColumn("met", F.col("coverage") >= target)


def reliability_bins(cells: DataFrame, n: int = 10, kind: str = "width", exact: bool = False) -> DataFrame:
    """By stat and bin of the prediction: mean prediction and mean outcome. One row for each stat is joined.

    Bins have equal width or, with ``kind="quantile"``, are cut at the
    prediction's quantiles, which a sketch estimates in bounded state unless
    ``exact`` (then one task keeps all values of a stat).
    """
    if kind == "quantile":
        at = [i / n for i in range(1, n)]
        edges = cells.groupBy("stat").agg(F.percentile("p", at).alias("edges")) if exact else quantile_sketches(cells, ["stat"], ["p"]).select("stat", quantiles("p", at).alias("edges"))
        place = (F.size(F.filter("edges", lambda e: e < F.col("p"))) + 1).cast("int")
        return cells.join(F.broadcast(edges), "stat").groupBy("stat", place.alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"), F.count("*").alias("n"))
    span = cells.groupBy("stat").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    width = F.col("hi") - F.col("lo")
    at = F.when(width > 0, F.least(F.floor((F.col("p") - F.col("lo")) * n / width) + 1, F.lit(n))).otherwise(F.lit(1)).cast("int")
    return cells.join(F.broadcast(span), "stat").groupBy("stat", at.alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"), F.count("*").alias("n"))


def compare_models(errors: DataFrame, model: str, baseline: str, strong: Sequence[str] = ("pts", "reb", "ast"), strong_target: float = 0.15, target: float = 0.05) -> DataFrame:
    """Relative reduction of the mean absolute error against a baseline, and whether it meets the stat's target."""
    wide = errors.groupBy("stat").pivot("model", [model, baseline]).agg(F.first("mae"))
    cut = F.lit(1.0) - F.try_divide(F.col(model), F.col(baseline))
    goal = F.when(F.col("stat").isin(list(strong)), strong_target).otherwise(target)
    return wide.select("stat", F.col(model).alias("mae_model"), F.col(baseline).alias("mae_baseline"), cut.alias("reduction"), (cut >= goal).alias("met"))


def summarize_samples(samples: DataFrame, keys: Sequence[str], stats: Sequence[str], exact: bool = True) -> DataFrame:
    """Mean, 10th and 90th percentile of each stat; ``exact=False`` keeps a sketch of bounded size for each key."""
    if not exact:
        found = samples.groupBy(*keys).agg(*[x for s in stats for x in (F.avg(s).alias(f"{s}_mean"), F.kll_sketch_agg_double(F.col(s).cast("double"), KLL_K).alias(s))])
        return found.select(*keys, *[x for s in stats for x in (F.col(f"{s}_mean"), quantiles(s, 0.1).alias(f"{s}_p10"), quantiles(s, 0.9).alias(f"{s}_p90"))])
    pct = F.percentile
    return samples.groupBy(*keys).agg(*[f(s).alias(f"{s}_{n}") for s in stats for n, f in (("mean", F.avg), ("p10", lambda c: pct(c, 0.1)), ("p90", lambda c: pct(c, 0.9)))])


def box_score_card(predicted: DataFrame, actual: DataFrame, games: DataFrame, keys: Sequence[str], stats: Sequence[str], game: str = "game_id") -> DataFrame:
    """Predicted beside actual rows of the given games, to which both are reduced before they meet; null keys are keys. ``keys`` hold the game."""
    p = predicted.join(games.select(game), game, "left_semi").select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(s).alias(f"{s}_pred") for s in stats])
    rows = actual.select(*keys, *stats).join(games.select(game), game, "left_semi")
    return rows.join(p, same_keys(rows, p, keys, [f"_k_{k}" for k in keys]), "left").drop(*[f"_k_{k}" for k in keys])
