"""Beta regression of rates: logit mean, constant precision.

Maximum likelihood by Fisher scoring. Every iteration is one pass: tasks add
up the score vector and the information matrix of their rows in numpy, and
(features + 2) squared numbers reach the driver, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIFT = 12  # the series below are exact to about 1e-13 from here on


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma, for positive numbers: recurrence up to a large argument, then the asymptotic series."""
    z = x + _SHIFT
    w = 1 / (z * z)
    series = w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    return np.log(z) - 0.5 / z - series - sum(1 / (x + k) for k in range(_SHIFT))


def trigamma(x: np.ndarray) -> np.ndarray:
    z = x + _SHIFT
    w = 1 / (z * z)
    series = w / z * (1 / 6 - w * (1 / 30 - w * (1 / 42 - w / 30)))
    return 1 / z + w / 2 + series + sum(1 / (x + k) ** 2 for k in range(_SHIFT))


def digamma_of(x: Column, shift: int = 12) -> Column:
    """The same for a column, inside the JVM."""
    z = x + F.lit(float(shift))
    w = F.lit(1.0) / (z * z)
    series = w * (F.lit(1 / 12) - w * (F.lit(1 / 120) - w * (F.lit(1 / 252) - w / 240)))
    steps = sum((F.lit(1.0) / (x + F.lit(float(k))) for k in range(1, shift)), F.lit(1.0) / x)
    return F.log(z) - F.lit(0.5) / z - series - steps


@dataclass(frozen=True)
class BetaModel:
    """Intercept and a coefficient for each feature on the logit scale; ``rows`` is the number fitted."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    precision: float
    rows: int
    iterations: int


def _totals(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``of(design, y)`` over batches; one short vector for each task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
                total = total + of(np.column_stack([np.ones(b.num_rows), *cols[1:]]), cols[0])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["at", "value"])

    found = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r["at"]] = r["value"]
    return out


def _parts(beta: np.ndarray, precision: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Score of (coefficients, log precision), then the expected information, row by row of the matrix."""
    mean = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    a, b, slope = mean * precision, (1 - mean) * precision, mean * (1 - mean)
    off = np.log(y / (1 - y)) - digamma(a) + digamma(b)
    ta, tb = trigamma(a), trigamma(b)
    by_precision = mean * off + np.log1p(-y) - digamma(b) + digamma(np.float64(precision))
    score = np.r_[precision * (x * (slope * off)[:, None]).sum(0), precision * by_precision.sum()]
    info = np.empty((len(beta) + 1,) * 2)
    info[:-1, :-1] = (x * (precision**2 * (ta + tb) * slope**2)[:, None]).T @ x
    info[:-1, -1] = info[-1, :-1] = precision**2 * (x * (slope * (ta * mean - tb * (1 - mean)))[:, None]).sum(0)
    info[-1, -1] = precision**2 * (ta * mean**2 + tb * (1 - mean) ** 2 - trigamma(np.float64(precision))).sum()
    return np.r_[score, info.ravel()]


def rate_rows(df: DataFrame, made: str, attempted: str, features: Sequence[str]) -> DataFrame:
    """(y, features) of rows with attempts and all features; y is the rate, at most 1."""
    rows = df.where((F.col(attempted) > 0) & F.col(made).isNotNull()).select(F.least(F.col(made) / F.col(attempted), F.lit(1.0)).cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
    return rows.where("y >= 0").dropna()


def squeezed(y: Column, rows: int) -> Column:
    """Rates of 0 and 1 have no density; all are drawn to the middle by half a row's share."""
    return (y * (rows - 1) + 0.5) / F.lit(float(max(rows, 1)))


def fit_beta(train: DataFrame, made: str, attempted: str, features: Sequence[str], tol: float = 1e-9, most: int = 100) -> BetaModel:
    """Rows without attempts or with a null feature teach nothing. ``tol`` bounds every score equation, for each row."""
    rows = rate_rows(train, made, attempted, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, p = rows.count(), len(features) + 1
        if n == 0:
            raise ValueError("no rows to fit")
        rows = rows.withColumn("y", squeezed(F.col("y"), n))
        sums = _totals(rows, lambda x, y: np.r_[(x.T @ x).ravel(), x.T @ np.log(y / (1 - y))])
        beta = np.linalg.lstsq(sums[: p * p].reshape(p, p), sums[p * p :], rcond=None)[0]

        def spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            line = x @ beta
            m = 1 / (1 + np.exp(-line))
            return np.array([((np.log(y / (1 - y)) - line) ** 2).sum(), (1 / (m * (1 - m))).sum()])

        square, inverse = _totals(rows, spread)
        precision = max(inverse / n / max(square / n, 1e-12) - 1, 0.5)
        for i in range(1, most + 1):
            found = _totals(rows, lambda x, y, at=(beta, precision): _parts(*at, x, y))
            score, info = found[: p + 1], found[p + 1 :].reshape(p + 1, p + 1)
            if np.abs(score).max() <= tol * n:
                return BetaModel(tuple(features), tuple(beta.tolist()), float(precision), n, i)
            step = np.linalg.lstsq(info, score, rcond=None)[0]
            step *= min(1.0, 1.0 / max(abs(step[-1]), 1e-12))  # the precision at most triples or falls to a third
            beta, precision = beta + step[:-1], float(precision * np.exp(step[-1]))
        raise ArithmeticError(f"no maximum after {most} iterations")
    finally:
        rows.unpersist()


def predict_beta(model: BetaModel, df: DataFrame) -> DataFrame:
    """Adds ``pred``, the mean rate; null where a feature is null."""
    line = sum((F.lit(c) * F.col(f).cast("double") for c, f in zip(model.coefficients[1:], model.features)), F.lit(model.coefficients[0]))
    return df.withColumn("pred", F.lit(1.0) / (F.lit(1.0) + F.exp(-line)))


def beta_scores(model: BetaModel, df: DataFrame, made: str, attempted: str) -> DataFrame:
    """(equation, score): the score equations of the fit, a row's share of each; all are zero at the maximum."""
    rows = predict_beta(model, rate_rows(df, made, attempted, model.features)).withColumn("y", squeezed(F.col("y"), model.rows))
    mean, p = F.col("pred"), F.lit(model.precision)
    low, high = digamma_of(mean * p), digamma_of((1 - mean) * p)
    rows = rows.withColumn("_off", F.log(F.col("y") / (1 - F.col("y"))) - low + high).withColumn("_w", p * mean * (1 - mean) * F.col("_off"))
    last = p * (mean * F.col("_off") + F.log(1 - F.col("y")) - high + digamma_of(p))
    cells = [F.struct(F.lit("intercept").alias("equation"), F.col("_w").alias("s"))] + [F.struct(F.lit(f).alias("equation"), (F.col("_w") * F.col(f)).alias("s")) for f in model.features] + [F.struct(F.lit("precision").alias("equation"), last.alias("s"))]
    return rows.select(F.inline(F.array(*cells))).groupBy("equation").agg(F.avg("s").alias("score"), F.count("*").alias("n"))


def save_beta(model: BetaModel, spark: SparkSession, path: str) -> None:
    row = [(list(model.features), list(model.coefficients), model.precision, model.rows, model.iterations)]
    spark.createDataFrame(row, "features array<string>, coefficients array<double>, precision double, rows long, iterations int").coalesce(1).write.mode("overwrite").parquet(path)


def load_beta(spark: SparkSession, path: str) -> BetaModel:
    r = spark.read.parquet(path).first()
    return BetaModel(tuple(r.features), tuple(r.coefficients), r.precision, r.rows, r.iterations)
