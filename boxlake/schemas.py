"""Declared tables: raw payloads, typed tables, and their constraint columns."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _DATE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.DateType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in columns.items()])


#: Counts of a box line, in table order.
COUNTS = ("pts", "fgm", "fga", "tpm", "tpa", "ftm", "fta", "oreb", "dreb", "reb", "ast", "stl", "blk", "tov", "pf")
# Raw field of each count.
RAW_COUNTS = {
    "points": "pts", "fieldGoalsMade": "fgm", "fieldGoalsAttempted": "fga", "threePointersMade": "tpm", "threePointersAttempted": "tpa",
    "freeThrowsMade": "ftm", "freeThrowsAttempted": "fta", "reboundsOffensive": "oreb", "reboundsDefensive": "dreb", "reboundsTotal": "reb",
    "assists": "ast", "steals": "stl", "blocks": "blk", "turnovers": "tov", "foulsPersonal": "pf",
}

RAW_GAME = _table(SEASON_ID=_S, TEAM_ID=_L, TEAM_ABBREVIATION=_S, GAME_ID=_S, GAME_DATE=_S, MATCHUP=_S, WL=_S, PTS=_I, MIN=_I)
RAW_PLAYER_BOX = _table(gameId=_S, teamId=_L, teamTricode=_S, personId=_L, firstName=_S, familyName=_S, position=_S, comment=_S, minutes=_S, **dict.fromkeys(RAW_COUNTS, _I), plusMinusPoints=_D)
RAW_TEAM_BOX = _table(gameId=_S, teamId=_L, teamTricode=_S, minutes=_S, **dict.fromkeys(RAW_COUNTS, _I), plusMinusPoints=_D)
GAME = _table(
    game_id=_S, season=_I, date=_DATE, home_team_id=_L, away_team_id=_L, home_team_abbr=_S, away_team_abbr=_S, home_pts=_I, away_pts=_I,
    is_overtime=_B, is_playoffs=_B, dropped=_B, dropped_reason=_S,
)
PLAYER_BOX = _table(
    game_id=_S, player_id=_L, player_name=_S, team_id=_L, team_abbr=_S, position=_S, minutes=_D, **dict.fromkeys(COUNTS, _I), plus_minus=_D,
    is_starter=_B, is_active=_B, dnp=_B,
)
TEAM_BOX = _table(game_id=_S, team_id=_L, team_abbr=_S, is_home=_B, minutes=_D, **dict.fromkeys(COUNTS, _I), plus_minus=_D, pace=_D, off_rtg=_D, def_rtg=_D)
ROSTER = _table(team_id=_L, season=_I, player_ids=T.ArrayType(_L))
PLAYER_INFO = _table(player_id=_L, name=_S, birthdate=_DATE, height_in=_D, weight_lbs=_D, position=_S, draft_year=_I, rookie_season=_I)
SIM_PLAYER_BOX = _table(sample_id=_L, game_id=_S, side=_S, player_id=_L, player_name=_S, minutes=_D, **dict.fromkeys(COUNTS, _I), plus_minus=_D)
ARENA = _table(team_abbr=_S, lat=_D, lon=_D, altitude_ft=_D)
