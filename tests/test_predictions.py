"""Season averages and cards: one deal of the tables for all branches, null keys."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from boxlake.operators import baseline, metrics
from boxlake.plans import bridge, entries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["met1_mae", "met7_card"])
def test_branches_share_one_deal(spark, monkeypatch, name):
    """All exchanges of lines are the same, so that one is used for all."""
    monkeypatch.setattr(bridge, "TASK_LINES", 100)
    deals = re.findall(r"Exchange hashpartitioning\(l_orderkey.*?FileScan[^\n]*", _plan(entries.QUERIES[name](spark, SMALL)), re.S)
    assert len(deals) > 1 and len({re.sub(r"#\d+L?|plan_id=\d+|[ :|+-]", "", d) for d in deals}) == 1


def test_means_of_null_players(spark):
    """A player without id has no last season and gets the position's mean; the means take rows of training seasons only."""
    rows = spark.createDataFrame([(None, 1, "C", 4, 1), (None, 2, "C", 9, 1), (7, 1, "C", 2, 1), (7, 2, "C", 8, 1), (8, 2, "PG", 5, 1)], "player_id long, season int, position string, pts long, secs long").withColumn("game_date", F.make_date(F.col("season") + 2000, F.lit(1), F.lit(1)))
    got = baseline.season_average_baseline(rows, "pts", F.col("secs") > 0, F.col("season") <= 1)
    assert {(r.player_id, r.season): (r.pred, r.tier) for r in got.collect()} == {(None, 1): (3.0, 3), (None, 2): (3.0, 3), (7, 1): (3.0, 3), (7, 2): (2.0, 2), (8, 2): (None, None)}


def test_card_pairs_null_keys(spark):
    rows = spark.createDataFrame([(1, None, 5), (1, 2, 6), (3, 2, 7)], "game_id long, player_id long, pts long")
    got = metrics.box_score_card(rows.withColumn("pts", F.col("pts") + 1), rows, rows.where("game_id = 1").select("game_id").distinct(), ["game_id", "player_id"], ["pts"])
    assert sorted(map(tuple, got.select("game_id", "player_id", "pts", "pts_pred").collect()), key=repr) == [(1, 2, 6, 7), (1, None, 5, 6)]
