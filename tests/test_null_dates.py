"""A row without a date has no past and is nobody's past."""

import datetime

import pytest
from pyspark.sql import functions as F

from boxlake.operators import context, joins, matchup, rolling

D1, D2, D3 = (datetime.date(2020, 1, n) for n in (1, 2, 3))
ROWS = [(1, 1, D1, 2020, 5), (1, 2, None, 2020, 7), (1, 3, D2, 2020, 9), (1, 4, None, 2020, 11)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "e long, g long, d date, season int, x long")


def test_rolling(rows):
    out = rolling.prior_rolling(rows, ["e"], "d", ["g"], {"x": F.col("x")}, (2,), keep_date=True)
    assert {r.g: (r.n_2, r.x_sum_2, r.last_contributing) for r in out.collect()} == {1: (0, None, None), 2: (0, None, None), 3: (1, 5, D1), 4: (0, None, None)}
    rolling.assert_no_future(out, "d")
    with pytest.raises(AssertionError):
        rolling.assert_no_future(out.withColumn("last_contributing", F.lit(D1)).where("d is null"), "d")


def test_to_date_and_gaps(rows):
    out = rolling.season_to_date(rows, ["e"], "season", "d", ["x"])
    assert {r.g: (r.std_n, r.std_x) for r in out.collect()} == {1: (0, None), 2: (0, None), 3: (1, 5), 4: (0, None)}
    assert {r.g: r.days_since_last for r in rolling.days_since_last(rows, ["e"], "d").collect()} == {1: None, 2: None, 3: 1, 4: None}


def test_asof(spark, rows):
    right = rows.select("e", "d", F.col("x").alias("v"))
    for strict, want in ((True, {1: None, 2: None, 3: 5, 4: None}), (False, {1: 5, 2: None, 3: 9, 4: None})):
        assert {r.g: r.asof_v for r in joins.asof_join(rows.select("e", "d", "g"), right, ["e"], "d", ["v"], strict=strict).collect()} == want


def test_schedule_and_travel(rows):
    games = rows.select(F.col("e").alias("team_id"), F.col("g").alias("game_id"), F.col("d").alias("game_date"), F.col("x").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    load = {r.game_id: (r.rest_days, r.b2b, r.three_in_four, r.four_in_six) for r in context.schedule_load(games.union(games).union(games)).collect()}
    assert load[2] == load[4] == (None, 0, 0, 0) and load[3] == (1, 1, 1, 1)
    miles = {r.game_id: r.travel_miles_prev for r in context.travel_miles(games).collect()}
    assert miles[1] is miles[2] is miles[4] is None and miles[3] == pytest.approx(276.4, abs=0.1)


def test_matchup(spark):
    rows = spark.createDataFrame([(1, D1, 7, 8, 3), (2, None, 8, 7, 50), (3, D3, 8, 7, 1)], "game_id long, game_date date, home_team long, away_team long, margin long")
    assert {r.game_id: r.h2h_last_margin for r in matchup.last_meeting_margin(rows).collect()} == {1: 0, 2: 0, 3: -3}
    players = rows.selectExpr("game_id", "game_date", "2020 as season", "1 as opp_id", "'C' as position", "margin as v", "1 as p")
    got = {r.game_id: (r.allowed, r.allowed_per) for r in matchup.allowed_by_position(players, "v", "p").collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (3, 1)}
