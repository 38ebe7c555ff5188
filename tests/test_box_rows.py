"""Parsing, pairing and validation of single rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from boxlake import schemas
from boxlake.functions import scalar
from boxlake.operators import checks, etl
from boxlake.sources import raw

GAME = "SEASON_ID string, TEAM_ID long, TEAM_ABBREVIATION string, GAME_ID string, GAME_DATE string, MATCHUP string, WL string, PTS int, MIN int"
HOME = ("21987", 71, "OWL", "0000000417", "1988-02-11", "OWL vs. ELK", "W", 93, 240)
AWAY = ("21987", 64, "ELK", "0000000417", "1988-02-11", "ELK @ OWL", "L", 88, 240)


@pytest.mark.parametrize("text,minutes", [("", 0.0), (None, 0.0), ("00:00", 0.0), ("7:45", 7.75), ("0:06", 0.1), ("41:36", 41.6), ("61:03", 61.05), ("x:y", None), ("12", None)])
def test_minutes(spark, text, minutes):
    got = spark.createDataFrame([(text,)], "m string").select(scalar.parse_mmss(F.col("m"))).first()[0]
    assert got == (None if minutes is None else pytest.approx(minutes))


def _players(spark, *rows):
    return etl.player_box_from_raw(raw.conform(spark.createDataFrame(list(rows)), schemas.RAW_PLAYER_BOX))


STARTER = dict(
    gameId="0000000417", teamId=64, teamTricode="ELK", personId=90210, firstName="Ida", familyName="Marsh", position="C", comment="", minutes="29:24", points=20, fieldGoalsMade=7, fieldGoalsAttempted=13, threePointersMade=3,
    threePointersAttempted=4, freeThrowsMade=3, freeThrowsAttempted=3, reboundsOffensive=4, reboundsDefensive=2, reboundsTotal=6, assists=5, steals=2, blocks=1, turnovers=4, foulsPersonal=3, plusMinusPoints=-8.0)


def test_starter_row(spark):
    row = _players(spark, STARTER | {"somethingNew": 1}).first()
    assert (row.game_id, row.player_id, row.minutes, row.is_starter, row.dnp, row.pts, row.reb, row.plus_minus) == ("0000000417", 90210, pytest.approx(29.4), True, False, 20, 6, -8.0)
    assert "somethingNew" not in row.asDict()


def test_absent_player_row(spark):
    row = _players(spark, dict(gameId="0000000417", teamId=64, personId=38, firstName="Oda", familyName="", position="", comment="", minutes="")).first()
    assert row.player_name == "Oda" and row.dnp and not row.is_starter and row.is_active
    assert all(row[c] == 0 for c in schemas.COUNTS)


@pytest.mark.parametrize("change,name", [
    ({"fgm": 14}, "fgm_le_fga"), ({"tpa": 2}, "tpm_le_tpa"), ({"ftm": 4}, "ftm_le_fta"), ({"fgm": 2}, "tpm_le_fgm"), ({"tpa": 14}, "tpa_le_fga"), ({"reb": 7}, "reb_sum"), ({"minutes": 0.0}, "dnp_minutes"), ({"dnp": True}, "dnp_minutes"),
    ({"ast": -1}, "non_negative"), ({"stl": 2.5}, "integral"), ({"pts": 1}, "pts_sum"),
])
def test_rejects(spark, change, name):
    rows = _players(spark, STARTER).withColumns({k: F.lit(v) for k, v in change.items()})
    valid, rejected = checks.validate(rows, checks.box_checks(points=True))
    assert valid.count() == 0 and name in rejected.first().violations
    with pytest.raises(ValueError, match=name):
        checks.validate(rows, checks.box_checks(points=True), mode="fail")


@pytest.mark.parametrize("change,name", [({"tpa": 2}, "tpm_le_tpa"), ({"fga": 3, "fgm": 3}, "tpa_le_fga"), ({"oreb": 9}, "reb_sum"), ({"blk": 0.25}, "integral"), ({"minutes": -1.0}, "non_negative")])
def test_team_rejects(spark, change, name):
    teams = _players(spark, STARTER).drop("dnp", "player_id")
    assert checks.validate(teams, checks.team_checks(points=True))[0].count() == 1
    _, rejected = checks.validate(teams.withColumns({k: F.lit(v) for k, v in change.items()}), checks.team_checks())
    assert rejected.first().violations == [name]


def test_absent_players_have_no_minutes(spark):
    rows = spark.createDataFrame([(True, 0.0), (True, 3.0), (False, 3.0), (False, 0.0), (None, 1.0)], "dnp boolean, minutes double")
    valid, rejected = checks.validate(rows, checks.absence_checks())
    assert [tuple(r) for r in rejected.collect()] == [(True, 3.0, ["absent_minutes"])] and valid.count() == 4


def test_valid_row_passes(spark):
    valid, rejected = checks.validate(_players(spark, STARTER), checks.box_checks(points=True))
    assert valid.count() == 1 and rejected.count() == 0


@pytest.mark.parametrize("rows", [[HOME, AWAY], [AWAY, HOME]])
def test_pairs_in_either_order(spark, rows):
    games, rejected = etl.build_games(spark.createDataFrame(rows, GAME))
    g = games.first()
    assert (g.home_team_abbr, g.away_team_abbr, g.season, g.date, g.home_pts, g.is_overtime, g.is_playoffs) == ("OWL", "ELK", 1987, datetime.date(1988, 2, 11), 93, False, False)
    assert rejected.count() == 0


def test_overtime_and_playoffs(spark):
    rows = [("41987", *HOME[1:8], 290), ("41987", *AWAY[1:8], 290)]
    g = etl.build_games(spark.createDataFrame(rows, GAME))[0].first()
    assert g.is_overtime and g.is_playoffs


@pytest.mark.parametrize("rows,reason", [([HOME], "row_count"), ([HOME, (*AWAY[:3], "0000000418", *AWAY[4:])], "row_count"), ([HOME, (*AWAY[:5], "ELK vs. OWL", *AWAY[6:])], "ambiguous_home"), ([(*HOME[:5], "OWL @ ELK", *HOME[6:]), AWAY], "ambiguous_home")])
def test_pair_rejects(spark, rows, reason):
    games, rejected = etl.build_games(spark.createDataFrame(rows, GAME))
    assert games.count() == 0 and {r.reason for r in rejected.collect()} == {reason}


def test_round_trip_keeps_zeros(spark, tmp_path):
    rows = _players(spark, STARTER).withColumn("season", F.lit(1987))
    raw.write_interim(rows, str(tmp_path / "t"))
    back = spark.read.schema(rows.schema).parquet(str(tmp_path / "t"))
    assert back.select(sorted(rows.columns)).collect() == rows.select(sorted(rows.columns)).collect()
    assert back.first().game_id == "0000000417"


def test_conform_keeps_extra_and_flags_bad_casts(spark):
    df = spark.createDataFrame([("12", "x", 1)], "PTS string, MIN string, more int")
    row = raw.conform(df, schemas.RAW_GAME, extra="allow").first()
    assert (row.PTS, row.MIN, row.more, row.GAME_ID) == (12, None, 1, None)
