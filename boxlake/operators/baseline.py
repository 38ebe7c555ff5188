"""Baselines: season averages, generalized linear models, apportioned minutes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import tiered
from .rolling import season_to_date


def _means(df: DataFrame, stats: Sequence[str], played: Column, train: Column) -> tuple[DataFrame, DataFrame]:
    """``_last_<stat>`` by ``_player`` and ``_next``, the season after, and ``_pos_<stat>`` by position over training rows; both from one set of sums.

    Keys of the past come out of an aggregate, and training rows are told by
    a condition: a filter on either would be pushed down to the sources, and
    Spark could not use one exchange of them for all branches.
    """
    names = ["_n", *[f"_s_{s}" for s in stats]]
    sums = df.where(played).groupBy("player_id", "season", "position", train.alias("_train")).agg(F.count("*").alias("_n"), *[F.sum(s).alias(f"_s_{s}") for s in stats])
    mean = lambda prefix: [F.try_divide(F.col(f"_s_{s}"), F.col("_n")).alias(f"{prefix}{s}") for s in stats]
    last = sums.groupBy("player_id", "season").agg(F.max("player_id").alias("_player"), (F.max("season") + 1).alias("_next"), *[F.sum(c).alias(c) for c in names])
    position = sums.groupBy("position").agg(*[F.sum(F.when(F.col("_train"), F.col(c))).alias(c) for c in names])
    return last.select("_player", "_next", *mean("_last_")), position.select("position", *mean("_pos_"))


def _with_means(std: DataFrame, last: DataFrame, position: DataFrame) -> DataFrame:
    out = std.join(last, (std["player_id"] == last["_player"]) & (std["season"] == last["_next"]), "left").drop("_player", "_next")
    return out.join(F.broadcast(position), "position", "left")  # one row for each position


def season_average_baseline(df: DataFrame, stat: str, played: Column, train: Column) -> DataFrame:
    """``pred`` and ``tier``: season to date, else last season's mean, else the position's mean over training rows."""
    std = season_to_date(df, ["player_id"], "season", "game_date", [stat], played)
    std = std.withColumn("_own", F.try_divide(F.col(f"std_{stat}").cast("double"), F.col("std_n"))).drop("std_n", f"std_{stat}")
    out, found = _with_means(std, *_means(df, [stat], played, train)), ["_own", f"_last_{stat}", f"_pos_{stat}"]
    tier = F.coalesce(*[F.when(F.col(c).isNotNull(), i) for i, c in enumerate(found, 1)])
    return out.withColumns({"pred": F.coalesce(*found), "tier": tier}).drop(*found)


def season_average_predictions(df: DataFrame, stats: Sequence[str], played: Column, train: Column) -> DataFrame:
    """``pred_<stat>`` of :func:`season_average_baseline` for several stats, with one pass of each step for all of them."""
    std = season_to_date(df, ["player_id"], "season", "game_date", stats, played)
    out = _with_means(std, *_means(df, stats, played, train))
    preds = {f"pred_{s}": F.coalesce(F.try_divide(F.col(f"std_{s}").cast("double"), F.col("std_n")), f"_last_{s}", f"_pos_{s}") for s in stats}
    return out.withColumns(preds).select(*df.columns, *preds)


def _features(df: DataFrame, features: Sequence[str], invalid: str = "skip") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid=invalid).transform(df)


def _fitted(model, rows: DataFrame, label: str, weight: str | None, features: Sequence[str]):
    """Rows with a null feature teach nothing. What the iterations read is computed once, and spills to disk."""
    cols = ["features", label] + ([weight] if weight else [])
    rows = _features(rows, features).select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return model.fit(rows)
    finally:
        rows.unpersist()


def fit_poisson(train: DataFrame, stat: str, features: Sequence[str], reg: float = 0.0):
    """Poisson model with log link of a counting stat."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol=stat, featuresCol="features", predictionCol="pred", regParam=reg, maxIter=50, tol=1e-10)
    return _fitted(glm, train.where(F.col(stat).isNotNull()), stat, None, features)


def fit_rate(train: DataFrame, made: str, attempted: str, features: Sequence[str], kind: str = "binomial"):
    """Percentage model: binomial weighted by attempts, or ridge. Rows without attempts, or with unknown ones, teach nothing.

    :func:`beta.fit_beta` fits a Beta regression.
    """
    from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression

    rows = train.where((F.col(attempted) > 0) & F.col(made).isNotNull()).withColumns({"_rate": F.least(F.col(made) / F.col(attempted), F.lit(1.0)), "_w": F.col(attempted).cast("double")})
    if kind == "ridge":
        model = LinearRegression(labelCol="_rate", weightCol="_w", predictionCol="pred", regParam=0.1, elasticNetParam=0.0)
    else:
        model = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="_rate", weightCol="_w", predictionCol="pred", maxIter=50, tol=1e-10)
    return _fitted(model, rows, "_rate", "_w", features)


def predict(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``pred`` to every row; null where a feature is null."""
    known = F.forall(F.array(*[F.col(f).cast("double").isNotNull() for f in features]), lambda x: x)
    return model.transform(_features(df, features, "keep")).withColumn("pred", F.when(known, F.col("pred"))).drop("features")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str, kind: str = "glm"):
    from pyspark.ml.regression import GeneralizedLinearRegressionModel, LinearRegressionModel

    return (LinearRegressionModel if kind == "ridge" else GeneralizedLinearRegressionModel).load(path)


def softmax_share(df: DataFrame, group: Sequence[str], score: str, name: str = "share") -> DataFrame:
    by = Window.partitionBy(*group)
    e = F.exp(F.col(score) - F.max(score).over(by))
    return df.withColumn("_e", e).withColumn(name, F.col("_e") / F.sum("_e").over(by)).drop("_e")


def apportion(df: DataFrame, group: Sequence[str], weight: str, units: int, tiebreak: Sequence[str], name: str = "units") -> DataFrame:
    """Whole units that add up to ``units`` in every group, by largest remainder of integer weights.

    Ties go to the tiebreak's order. A group without weight gets zeros and
    ``no_weight``.
    """
    by = Window.partitionBy(*group)
    out = df.withColumn("_w", F.coalesce(F.col(weight), F.lit(0)).cast("long")).withColumn("_sum", F.sum("_w").over(by))
    out = out.withColumns({"_base": F.when(F.col("_sum") > 0, F.expr(f"(_w * {units}L) div _sum")).otherwise(F.lit(0)), "_rest": F.when(F.col("_sum") > 0, (F.col("_w") * units) % F.col("_sum")).otherwise(F.lit(0))})
    place = F.row_number().over(by.orderBy(F.desc("_rest"), *tiebreak))
    left = F.when(F.col("_sum") > 0, F.lit(units) - F.sum("_base").over(by)).otherwise(F.lit(0))
    out = out.withColumns({"_place": place, "_left": left})
    return out.withColumns({name: F.col("_base") + (F.col("_place") <= F.col("_left")).cast("int"), "no_weight": F.col("_sum") == 0}).drop("_w", "_sum", "_base", "_rest", "_place", "_left")


def project_to_constraints(df: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Nothing negative, made at most attempted, threes within field goals; rebounds and points follow."""
    out = df.withColumns({c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in counts})
    out = out.withColumns({"tpa": F.least("tpa", "fga"), "fgm": F.least("fgm", "fga"), "ftm": F.least("ftm", "fta")})
    out = out.withColumn("tpm", F.least("tpm", "tpa", "fgm"))
    return out.withColumns({"reb": F.col("oreb") + F.col("dreb"), "pts": 2 * F.col("fgm") + F.col("tpm") + F.col("ftm")})


def role_means(vectors: DataFrame, role: str, vector: str) -> DataFrame:
    """Mean vector of each role, element by element."""
    flat = vectors.select(role, F.posexplode(vector).alias("_i", "_x")).groupBy(role, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return flat.groupBy(role).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_a")).select(role, F.transform("_a", lambda s: s["_m"]).alias("role_vector"))


#: Role means are broadcast up to this many roles.
MOST_ROLES = 10_000


def cold_start_fill(wanted: DataFrame, vectors: DataFrame, key: str, role: str, vector: str, default_role: int | str) -> DataFrame:
    """Own vector, else the role's mean, else the default role's mean; with ``tier``."""
    own = vectors.select(key, F.transform(vector, lambda x: x.cast("double")).alias("own_vector"))
    means = role_means(vectors, role, vector)
    found = means.limit(MOST_ROLES + 1).collect()
    if len(found) <= MOST_ROLES:
        means = F.broadcast(means.sparkSession.createDataFrame(found, means.schema))
    fallback = means.where(F.col(role) == F.lit(default_role)).select(F.lit(1).alias("_one"), F.col("role_vector").alias("default_vector"))
    return tiered(wanted.withColumn("_one", F.lit(1)), [(own, [key], "own_vector"), (means, [role], "role_vector"), (fallback, ["_one"], "default_vector")], "vector").drop("_one")


def allocate_plus_minus(df: DataFrame, group: Sequence[str], margin: str, minutes: str) -> DataFrame:
    """The team's margin by share of the time on the floor."""
    total = F.sum(minutes).over(Window.partitionBy(*group))
    return df.withColumn("plus_minus", F.try_divide(F.col(margin).cast("double") * F.col(minutes) * 5, total))


def null_policy(df: DataFrame, cols: Sequence[str], strategy: str = "keep", group: Sequence[str] = ()) -> DataFrame:
    """keep leaves nulls; zero and mean fill them and add ``<col>_missing``."""
    if strategy == "keep":
        return df
    fill = lambda c: F.lit(0)
    out = df
    if strategy == "mean" and group:  # one row for each group is joined; null groups are a group
        means = df.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
        same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
        out, fill = df.join(means, same, "left"), lambda c: F.col(f"_m_{c}")
    elif strategy == "mean":
        means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
        fill = lambda c: F.lit(means[c])
    flags = [F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in cols]
    return out.select(*[F.coalesce(c, fill(c)).alias(c) if c in cols else c for c in df.columns], *flags)
