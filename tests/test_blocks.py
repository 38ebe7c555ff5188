"""Blocked operators equal the plain ones, whatever the skew, and no task gets a whole history."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from boxlake.operators import blocks, joins, rolling

ROWS = 60
SCHEMA = "e long, g long, d date, season int, x long, y double"


def history(seed, n=900):
    """One entity with nine of ten rows, one date with a third of them, null dates and entities, repeated rows."""
    rng, start = random.Random(seed), datetime.date(2020, 1, 1)
    rows = []
    for i in range(n):
        e = None if i % 50 == 0 else 7 if i % 10 else i % 4
        d = None if i % 23 == 0 else start + datetime.timedelta(200 if i % 3 == 0 else rng.randrange(400))
        rows.append((e, i, d, d.year if d else 2020, rng.choice([0, 5, None, 9, 30]), rng.random()))
    return rows + rows[:5]


def same(a, b, digits=9):
    assert set(a.columns) == set(b.columns)
    plain = lambda df: sorted(repr(tuple(round(v, digits) if isinstance(v, float) else v for v in r)) for r in df.select(*sorted(a.columns)).collect())
    assert plain(a) == plain(b)


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling(spark, seed):
    df = spark.createDataFrame(history(seed), SCHEMA).repartition(5)
    args = (df, ["e"], "d", ["g"], {"x": F.col("x"), "z": F.col("x") * 2}, (2, 7), F.col("x") > 0, True)
    same(blocks.prior_rolling_blocked(*args, rows=ROWS), rolling.prior_rolling(*args))
    same(blocks.prior_rolling_blocked(*args, reset_by=["season"], rows=ROWS), rolling.prior_rolling(*args, reset_by=["season"]))


def test_windows_longer_than_blocks(spark):
    df = spark.createDataFrame(history(3, 300), SCHEMA)
    args = (df, ["e"], "d", ["g"], {"x": F.col("x")}, (40, 200), None)
    same(blocks.prior_rolling_blocked(*args, rows=10), rolling.prior_rolling(*args))


def test_season_to_date(spark):
    df = spark.createDataFrame(history(4), SCHEMA).repartition(3)
    args = (df, ["e"], "season", "d", ["x"], F.col("x") > 0)
    same(blocks.season_to_date_blocked(*args, rows=ROWS), rolling.season_to_date(*args))
    none = (df, ["e"], "season", "d", ["x"])
    same(blocks.season_to_date_blocked(*none, rows=ROWS), rolling.season_to_date(*none))


@pytest.mark.parametrize("strict", [True, False])
def test_asof(spark, strict):
    df = spark.createDataFrame(history(5), SCHEMA)
    right = spark.createDataFrame(history(6, 400), SCHEMA).where("g % 3 = 0").select("e", "d", "g", F.col("x").alias("v"))
    args = (df, right, ["e"], "d", ["v", "g"], ["g"], strict)
    same(blocks.asof_join_blocked(*args, rows=ROWS), joins.asof_join(*args))


def test_asof_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_KEYS", 0)
    df = spark.createDataFrame(history(7), SCHEMA)
    right = df.where("g % 5 = 0").select("e", "d", F.col("x").alias("v"))
    same(blocks.asof_join_blocked(df, right, ["e"], "d", ["v"], rows=ROWS), joins.asof_join(df, right, ["e"], "d", ["v"]))


def test_short_histories_and_empty_tables(spark):
    df = spark.createDataFrame(history(8, 40), SCHEMA)
    assert blocks.cut_points(df, ["e"], "d", 1000) is None
    for some in (df, df.limit(0)):
        args = (some, ["e"], "d", ["g"], {"x": F.col("x")}, (3,))
        same(blocks.prior_rolling_blocked(*args), rolling.prior_rolling(*args))


def test_no_group_outgrows_its_bound(spark):
    """Of 9,000 rows of one entity, 3,000 on one date, none of the groups that a task takes has more than three blocks' rows."""
    df = spark.createDataFrame(history(9, 9000), SCHEMA).repartition(8)
    rows = 300
    cuts = blocks.cut_points(df, ["e"], "d", rows)
    left, right = blocks.asof_parts(df, df.select("e", "d", F.col("x").alias("v")), ["e"], "d", ["v"], [], cuts)
    group = ["e", "_block", "_copy"]
    assert max(r["count"] for r in left.where("d is not null").groupBy(*group).count().collect()) <= 3 * rows
    assert max(r["count"] for r in right.groupBy(*group).count().collect()) <= 3 * rows
    assert left.count() == df.count()
    sizes = blocks.with_block(df.where("d is not null and e = 7"), ["e"], "d", cuts).groupBy("_block").count().collect()
    assert len(sizes) > 15


def test_no_window_over_a_whole_entity(spark):
    """Every window of rows is partitioned by block too; those over blocks see one row, or a few, for each."""
    import re

    df = spark.createDataFrame(history(10), SCHEMA)
    out = blocks.prior_rolling_blocked(df, ["e"], "d", ["g"], {"x": F.col("x")}, (3,), rows=ROWS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    for keys in re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan):
        assert "_block" in keys or "d#" in keys or keys.count("#") == 1
    assert "SinglePartition" not in plan


def test_cuts_follow_dates_not_rows(spark, monkeypatch):
    """With ten times the rows on the same dates, what is cut into blocks stays as it is."""
    sizes, points = [], blocks.cut_points
    monkeypatch.setattr(blocks, "cut_points", lambda df, *rest: sizes.append(df.count()) or points(df, *rest))
    for n in (1, 10):
        df = spark.createDataFrame(history(11, 600), SCHEMA).distinct().join(spark.range(n).toDF("copy"))
        df = df.withColumn("g", F.col("g") * 100 + F.col("copy")).drop("copy")
        args = (df, ["e"], "season", "d", ["x"], F.col("x") > 0)
        same(blocks.season_to_date_blocked(*args, rows=ROWS), rolling.season_to_date(*args))
        right = df.where("g % 3 = 0").select("e", "d", "g", F.col("x").alias("v"))
        args = (df, right, ["e"], "d", ["v", "g"], ["g"])
        same(blocks.asof_join_blocked(*args, rows=ROWS), joins.asof_join(*args))
        args = (df, ["e"], "d", ["g"], {"x": F.col("x")}, (2,), F.col("x") > 0)
        same(blocks.prior_rolling_blocked(*args, rows=ROWS), rolling.prior_rolling(*args))
    assert len(sizes) == 6 and sizes[:2] == sizes[3:5]
    assert sizes[5] <= 2 * sizes[4]


def test_features_by_date_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_DATES", 0)
    df = spark.createDataFrame(history(12), SCHEMA)
    args = (df, ["e"], "d", ["g"], {"x": F.col("x")}, (3,), F.col("x") > 0, True)
    same(blocks.prior_rolling_blocked(*args, rows=ROWS), rolling.prior_rolling(*args))
