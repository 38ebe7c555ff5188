"""Features of the opponent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_day


def add_matchup(players: DataFrame, team_rolling: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The opponent's rolling values of the same game as ``opp_<col>``, null if the opponent has no row."""
    other = team_rolling.select("game_id", F.col("team_id").alias("opp_id"), *[F.col(c).alias(f"opp_{c}") for c in cols])
    return players.join(other, ["game_id", "opp_id"], "left")


def allowed_by_position(players: DataFrame, value: str, per: str) -> DataFrame:
    """(game_id, opp_id, position) -> season-to-date sums that the opponent allowed to a position before the game's date. Games without a date get and give none."""
    by_game = players.groupBy("season", "opp_id", "position", "game_id", "game_date").agg(F.sum(value).alias("_v"), F.sum(per).alias("_p"))
    before = Window.partitionBy("season", "opp_id", "position").orderBy(epoch_day("game_date")).rangeBetween(Window.unboundedPreceding, -1)
    dated = F.col("game_date").isNotNull()
    sums = [F.when(dated, F.sum(F.when(dated, F.col(c))).over(before)).alias(name) for c, name in (("_v", "allowed"), ("_p", "allowed_per"))]
    return by_game.select("game_id", "opp_id", "position", *sums)


def last_meeting_margin(games: DataFrame) -> DataFrame:
    """``h2h_last_margin`` of the two teams' last meeting on an earlier date, from the home side; 0 without one or without a date."""
    low, high = F.least("home_team", "away_team"), F.greatest("home_team", "away_team")
    sign = F.when(F.col("home_team") == low, 1).otherwise(-1)
    day = epoch_day("game_date")
    before = Window.partitionBy(low, high).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    last = F.when(day.isNotNull(), F.max(F.when(day.isNotNull(), F.struct(day, F.col("game_id"), (F.col("margin") * sign).alias("m")))).over(before))
    return games.withColumn("h2h_last_margin", F.coalesce(last["m"] * sign, F.lit(0)))
