"""Fits against plain ones, sketches within their errors, ids, reports in one pass."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlake.operators import baseline, beta, context, etl, metrics, sketches


def test_gamma_derivatives():
    x = np.array([0.05, 0.5, 1.0, 3.7, 250.0])
    euler = 0.5772156649015329
    assert beta.digamma(np.array([1.0, 0.5, 2.0])) == pytest.approx([-euler, -euler - 2 * np.log(2), 1 - euler], abs=1e-12)
    assert beta.trigamma(np.array([1.0, 0.5])) == pytest.approx([np.pi**2 / 6, np.pi**2 / 2], abs=1e-12)
    h = 1e-5
    assert (beta.digamma(x + h) - beta.digamma(x - h)) / (2 * h) == pytest.approx(beta.trigamma(x), rel=1e-6)


def made_of(rng, n, precision=12.0):
    rows = []
    for _ in range(n):
        a, b = rng.random(), float(rng.randrange(2))
        m = 1 / (1 + np.exp(-(-0.4 + 1.1 * a - 0.6 * b)))
        tries = rng.randrange(4, 30)
        rows.append((a, b, round(tries * rng.betavariate(m * precision, (1 - m) * precision)), tries))
    return rows


def test_beta_regression_equals_a_plain_fit(spark, tmp_path):
    """Row by row against Newton steps on numerical derivatives of the log likelihood, with nothing shared."""
    from math import lgamma

    rows = made_of(random.Random(1), 400)
    odd = [(None, 1.0, 3, 5), (0.2, None, 3, 5), (0.2, 1.0, 0, 0), (0.2, 1.0, None, 4), (0.3, 0.0, 5, None)]
    df = spark.createDataFrame([(a, b, m, t) for a, b, m, t in rows + odd], "a double, b double, made int, tries int").repartition(3)
    model = beta.fit_beta(df, "made", "tries", ["a", "b"])
    x = np.array([(1.0, a, b) for a, b, *_ in rows])
    y = np.array([(min(m / t, 1.0) * (len(rows) - 1) + 0.5) / len(rows) for *_, m, t in rows])

    def loss(v):
        mu = 1 / (1 + np.exp(-x @ v[:3]))
        p = np.exp(v[3])
        g = np.vectorize(lgamma)
        return -(lgamma(p) - g(mu * p) - g((1 - mu) * p) + (mu * p - 1) * np.log(y) + ((1 - mu) * p - 1) * np.log(1 - y)).sum()

    v, h = np.r_[0.0, 0.0, 0.0, 1.0], 1e-4
    eye = np.eye(4) * h
    for _ in range(40):
        grad = np.array([(loss(v + e) - loss(v - e)) / (2 * h) for e in eye])
        hess = np.array([[(loss(v + e + f) - loss(v + e - f) - loss(v - e + f) + loss(v - e - f)) / (4 * h * h) for f in eye] for e in eye])
        step = np.linalg.solve(hess, grad)
        v -= step / max(1.0, np.abs(step).max())
    assert model.rows == 400 and model.coefficients == pytest.approx(v[:3], abs=1e-4) and model.precision == pytest.approx(np.exp(v[3]), rel=1e-3)
    got = sorted((r.a, r.b, r.pred) for r in beta.predict_beta(model, df.where("a is not null and b is not null and tries > 0 and made is not null")).collect())
    want = sorted((a, b, 1 / (1 + np.exp(-(v[0] + v[1] * a + v[2] * b)))) for a, b, *_ in rows)
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-4)
    assert all(abs(r.score) < 1e-8 and r.n == 400 for r in beta.beta_scores(model, df, "made", "tries").collect())
    assert beta.predict_beta(model, df).where("pred is null").count() == 2
    beta.save_beta(model, spark, str(tmp_path / "m"))
    assert beta.load_beta(spark, str(tmp_path / "m")) == model
    with pytest.raises(ValueError):
        beta.fit_beta(df.limit(0), "made", "tries", ["a"])


@pytest.mark.parametrize("kind", ["poisson", "binomial"])
def test_generalized_linear_models_equal_a_plain_fit(spark, kind):
    rng = random.Random(2)
    rows = made_of(rng, 300)
    df = spark.createDataFrame([(a, b, float(m), float(t)) for a, b, m, t in rows], "a double, b double, made double, tries double")
    model = baseline.fit_poisson(df, "made", ["a", "b"]) if kind == "poisson" else baseline.fit_rate(df, "made", "tries", ["a", "b"])
    x, made, tries = np.array([(1.0, a, b) for a, b, *_ in rows]), np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
    v = np.zeros(3)
    for _ in range(50):
        if kind == "poisson":
            mean = np.exp(x @ v)
            grad, weight = x.T @ (made - mean), mean
        else:
            rate = 1 / (1 + np.exp(-x @ v))
            grad, weight = x.T @ (made - tries * rate), tries * rate * (1 - rate)
        v += np.linalg.solve((x * weight[:, None]).T @ x, grad)
    assert [model.intercept, *model.coefficients] == pytest.approx(v, abs=1e-6)


def test_unknown_makes_teach_nothing(spark):
    rows = [(a, float(m), float(t)) for a, _, m, t in made_of(random.Random(7), 100)]
    one, two = (baseline.fit_rate(spark.createDataFrame(x, "a double, made double, tries double"), "made", "tries", ["a"]) for x in (rows, rows + [(0.5, None, 9.0)] * 30))
    assert [two.intercept, *two.coefficients] == pytest.approx([one.intercept, *one.coefficients], abs=1e-9)


def test_ridge_rates(spark):
    rows = made_of(random.Random(3), 200)
    df = spark.createDataFrame([(a, b, float(m), float(t)) for a, b, m, t in rows], "a double, b double, made double, tries double")
    out = baseline.predict(baseline.fit_rate(df, "made", "tries", ["a", "b"], kind="ridge"), df, ["a", "b"])
    r = out.agg(F.sum(F.col("made") - F.col("tries") * F.col("pred"))).first()[0]
    assert r == pytest.approx(0, abs=1e-6) and out.select(F.stddev("pred")).first()[0] > 0.01


def test_quantile_sketches_merge(spark):
    """Any grouping of the parts gives quantiles whose ranks are off by no more than stated."""
    rng = random.Random(4)
    rows = [(i % 7, rng.gauss(0, 1) ** 3, None if i % 5 else float(i)) for i in range(30_000)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "part int, v double, w double").repartition(6)
    parts = sketches.quantile_sketches(df, ["part"], ["v", "w"])
    two = sketches.merge_quantiles(parts.withColumn("half", F.col("part") % 2), ["half"], ["v", "w"])
    values, at = np.sort([r[1] for r in rows if r[1] is not None]), [0.01, 0.1, 0.5, 0.9, 0.99]
    for merged in (sketches.merge_quantiles(parts, [], ["v", "w"]), sketches.merge_quantiles(two, [], ["v", "w"]), sketches.quantile_sketches(df, [], ["v", "w"])):
        got = merged.select(sketches.quantiles("v", at).alias("q")).first().q
        assert np.abs(np.searchsorted(values, got) / len(values) - at).max() <= sketches.rank_error()
    empty = {r.part: r.q for r in parts.select("part", sketches.quantiles("v", 0.5).alias("q")).collect()}
    assert empty[9] is None and sketches.quantile_sketches(df.limit(0), ["part"], ["v"]).count() == 0
    small = sketches.quantile_sketches(spark.createDataFrame([(float(i),) for i in range(11)], "v double"), [], ["v"])
    assert small.select(sketches.quantiles("v", 0.5).alias("q")).first().q == 5.0


def test_distinct_sketches_merge(spark):
    df = spark.range(60_000).selectExpr("id % 11 as part", "id % 20000 as k", "case when id % 3 = 0 then cast(id as string) end as s")
    parts = sketches.distinct_sketches(df, ["part"], ["k", "s"])
    two = sketches.merge_distinct(parts.withColumn("half", F.col("part") % 2), ["half"], ["k", "s"])
    one, other = (sketches.distinct_estimates(sketches.merge_distinct(x, [], ["k", "s"]), ["k", "s"]).first() for x in (parts, two))
    assert tuple(one) == tuple(other) and all(abs(e / 20_000 - 1) <= sketches.distinct_error() for e in one)


def test_bounded_quantile_bins_and_summaries(spark):
    rng = random.Random(5)
    cells = spark.createDataFrame([("s", rng.random() ** 2, rng.random()) for _ in range(20_000)], "stat string, p double, y double")
    n = [r.n for r in metrics.reliability_bins(cells, kind="quantile").collect()]
    assert len(n) == 10 and max(abs(x / 20_000 - 0.1) for x in n) <= 2 * sketches.rank_error()
    exact, near = (metrics.summarize_samples(cells, ["stat"], ["p"], exact=x).first() for x in (True, False))
    assert near.p_mean == exact.p_mean and abs(near.p_p10**0.5 - 0.1) < 0.01 and abs(near.p_p90**0.5 - 0.9) < 0.01


def test_dense_ids_by_range(spark):
    rng = random.Random(6)
    rows = [(f"k{rng.randrange(400)}",) for _ in range(3000)] + [(None,)] * 20
    df = spark.createDataFrame(rows, "k string").repartition(7)
    plain = lambda x: sorted(((r.k, r.dense_id) for r in x.collect()), key=repr)
    for ranges in (1, 5, 40):
        out = context.dense_entity_id_ranged(df, "k", 7, ranges=ranges)
        assert plain(out) == plain(context.dense_entity_id(df, "k", 7))
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert context.dense_entity_id_ranged(df.limit(0), "k").count() == 0


def test_ids_resolve_or_are_quarantined(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1), ("e", 1), (None, 1), ("zz", 1)], "ref string, g int")
    ids = spark.createDataFrame([("a", 10), ("a", 10), ("b", 20), ("b", 21), ("c", 30), ("d", 30), ("e", None), (None, 40), ("x", 10), ("x", 50)], "ref string, player_id long")
    good, bad = etl.resolve_ids(rows, ids, "ref", "player_id")
    assert sorted(map(tuple, good.collect())) == [("a", 1, 10), ("a", 2, 10)]
    assert {(r.ref, r.reason) for r in bad.collect()} == {("b", "ambiguous"), ("c", "shared"), ("d", "shared"), ("e", "unmatched"), ("zz", "unmatched"), (None, "missing_id")}
    assert good.count() + bad.count() == rows.count()


def test_report_is_counted_while_writing(spark, tmp_path):
    rows = spark.createDataFrame([(2000, "x"), (2000, "x"), (2001, "y"), (1900, "x"), (None, "y"), (2000, "odd")], "season int, reason string")
    rows.write.parquet(str(tmp_path / "in"))
    out = etl.write_with_report(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"), [2000, 2001], ["x", "y"])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(2000, "x", 2), (2001, "y", 1), (None, None, 3)], key=repr)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    empty = etl.write_with_report(rows.limit(0), str(tmp_path / "none"), [2000], ["x"])
    assert empty.count() == 0


def test_report_takes_one_pass(spark, tmp_path):
    """Each input row is computed once for table and report together."""
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000).selectExpr("cast(2000 + id % 3 as int) as season", "'x' as reason").repartition(4).mapInArrow(touch, "season int, reason string")
    out = etl.write_with_report(rows, str(tmp_path / "t"), [2000, 2001, 2002], ["x"])
    assert {r.season: r.n for r in out.collect()} == {2000: 334, 2001: 333, 2002: 333} and seen.value == 1000
