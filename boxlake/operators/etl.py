"""Raw payloads to typed tables: parsing, pairing, quarantine, reconciling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalar import five_positions, parse_mmss, season_from_id
from ..schemas import RAW_COUNTS


def build_games(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pair the two team rows of a game; (games, rejected with a reason)."""
    home = F.contains(F.coalesce("MATCHUP", F.lit("")), F.lit("vs."))
    side = F.struct("SEASON_ID", "TEAM_ID", "TEAM_ABBREVIATION", "GAME_DATE", "PTS", "MIN")
    rank = F.struct(home.cast("int"), "TEAM_ID")
    pairs = raw.groupBy("GAME_ID").agg(F.count("*").alias("n"), F.min("GAME_DATE").alias("first_date"), F.count_if(home).alias("n_home"), F.max_by(side, rank).alias("h"), F.min_by(side, rank).alias("a"))
    reason = F.when(F.col("GAME_ID").isNull(), "missing_game_id").when(F.col("n") != 2, "row_count").when(F.col("n_home") != 1, "ambiguous_home")
    pairs = pairs.withColumn("reason", reason)
    games = pairs.where(F.col("reason").isNull()).select(
        F.col("GAME_ID").alias("game_id"), season_from_id(F.col("h.SEASON_ID")).alias("season"), F.col("h.GAME_DATE").try_cast("date").alias("date"),
        F.col("h.TEAM_ID").alias("home_team_id"), F.col("a.TEAM_ID").alias("away_team_id"), F.col("h.TEAM_ABBREVIATION").alias("home_team_abbr"), F.col("a.TEAM_ABBREVIATION").alias("away_team_abbr"),
        F.coalesce("h.PTS", F.lit(0)).cast("int").alias("home_pts"), F.coalesce("a.PTS", F.lit(0)).cast("int").alias("away_pts"),
        (F.coalesce("h.MIN", F.lit(0)) > 240).alias("is_overtime"), F.startswith("h.SEASON_ID", F.lit("4")).alias("is_playoffs"),
        F.lit(False).alias("dropped"), F.lit(None).cast("string").alias("dropped_reason"))
    return games, pairs.where(F.col("reason").isNotNull()).select("GAME_ID", "n", "n_home", "first_date", "reason")


def _counts() -> list[Column]:
    return [F.coalesce(raw, F.lit(0)).cast("int").alias(name) for raw, name in RAW_COUNTS.items()]


def player_box_from_raw(raw: DataFrame) -> DataFrame:
    minutes = parse_mmss(F.col("minutes"))
    comment = F.coalesce("comment", F.lit(""))
    return raw.select(
        F.col("gameId").alias("game_id"), F.col("personId").alias("player_id"), F.trim(F.concat_ws(" ", "firstName", "familyName")).alias("player_name"), F.col("teamId").alias("team_id"),
        F.col("teamTricode").alias("team_abbr"), F.coalesce("position", F.lit("")).alias("position"), minutes.alias("minutes"), *_counts(), F.coalesce("plusMinusPoints", F.lit(0.0)).alias("plus_minus"),
        (F.coalesce("position", F.lit("")) != "").alias("is_starter"), (~F.startswith(comment, F.lit("Inactive"))).alias("is_active"), (minutes == 0).alias("dnp"))


def team_box_from_raw(raw: DataFrame, games: DataFrame) -> DataFrame:
    """Team lines; the side comes from the game header."""
    sides = games.select(F.col("game_id"), F.col("home_team_id").alias("_home"))
    lines = raw.select(
        F.col("gameId").alias("game_id"), F.col("teamId").alias("team_id"), F.col("teamTricode").alias("team_abbr"), parse_mmss(F.col("minutes")).alias("minutes"), *_counts(),
        F.coalesce("plusMinusPoints", F.lit(0.0)).alias("plus_minus"))
    return lines.join(sides, "game_id").withColumn("is_home", F.col("team_id") == F.col("_home")).drop("_home")


def merge_advanced(team_box: DataFrame, advanced: DataFrame, keys: Sequence[str] = ("game_id", "team_id"), cols: Sequence[str] = ("pace", "off_rtg", "def_rtg")) -> DataFrame:
    return team_box.join(advanced.select(*keys, *cols), list(keys), "left")


def possessions(df_prefix: str = "") -> Column:
    c = lambda n: F.col(df_prefix + n)
    return c("fga") + F.lit(0.44) * c("fta") - c("oreb") + c("tov")


def advanced_from_traditional(df: DataFrame) -> DataFrame:
    """True shooting, effective field goal share, possessions and offensive rating by the public formulas."""
    own = possessions()
    return df.withColumns({
        "ts_pct": F.try_divide(F.col("pts").cast("double"), 2 * (F.col("fga") + F.lit(0.44) * F.col("fta"))), "efg_pct": F.try_divide(F.col("fgm") + F.lit(0.5) * F.col("tpm"), F.col("fga").cast("double")),
        "poss": own, "off_rtg": F.try_divide(F.lit(100.0) * F.col("pts"), own)})


def def_rtg_from_opponent(team_box: DataFrame) -> DataFrame:
    """A team's defensive rating is its opponent's offensive rating."""
    other = team_box.select(F.col("game_id").alias("_game"), F.col("team_id").alias("_other"), F.col("off_rtg").alias("def_rtg"))
    here = team_box.drop("def_rtg")
    return here.join(other, (here["game_id"] == other["_game"]) & (here["team_id"] != other["_other"]), "left").drop("_game", "_other")


def derive_points(df: DataFrame) -> DataFrame:
    return df.withColumns({"pts": 2 * F.col("fgm") + F.col("tpm") + F.col("ftm"), "reb": F.col("oreb") + F.col("dreb")})


def roster_rows(rosters: DataFrame) -> DataFrame:
    """One row for each (team, season, player)."""
    return rosters.select("team_id", "season", F.explode("player_ids").alias("player_id"))


def normalize_roster(rows: DataFrame) -> DataFrame:
    """Sorted distinct player ids of each team and season."""
    return rows.groupBy("team_id", "season").agg(F.array_sort(F.collect_set("player_id")).alias("player_ids"))


def clean_player_info(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("player_id").try_cast("long").alias("player_id"), F.trim("name").alias("name"), F.col("birthdate").try_cast("date").alias("birthdate"),
        *[F.col(c).try_cast("double").alias(c) for c in ("height_in", "weight_lbs")], five_positions(F.col("position")).alias("position"),
        *[F.col(c).try_cast("int").alias(c) for c in ("draft_year", "rookie_season")])


def flag_dropped(games: DataFrame, team_box: DataFrame, regulation: float = 240.0) -> DataFrame:
    """Overtime games and games whose teams did not play the regulation minutes."""
    odd = team_box.groupBy("game_id").agg(F.max((F.abs(F.col("minutes") - regulation) > 0.1).cast("int")).alias("_odd"))
    reason = F.when(F.col("is_overtime"), "overtime").when(F.coalesce("_odd", F.lit(0)) == 1, "minutes")
    return games.drop("dropped", "dropped_reason").join(odd, "game_id", "left").withColumn("dropped_reason", reason).withColumn("dropped", F.col("dropped_reason").isNotNull()).drop("_odd")


def apply_filters(games: DataFrame, exclude_overtime: bool = True, exclude_short_games: bool = True) -> DataFrame:
    reason = F.coalesce("dropped_reason", F.lit(""))
    for on, name in ((exclude_overtime, "overtime"), (exclude_short_games, "minutes")):
        games = games.where(reason != name) if on else games
    return games


def active_roster(player_box: DataFrame) -> DataFrame:
    """Active players; those who did not play stay with zero minutes."""
    return player_box.where(F.col("is_active"))


def qa_report(rows: DataFrame, season: str = "season", reason: str = "reason") -> DataFrame:
    return rows.groupBy(season, reason).agg(F.count("*").alias("n"))


def write_with_report(rows: DataFrame, path: str, seasons: Sequence[int], reasons: Sequence[str], season: str = "season", reason: str = "reason") -> DataFrame:
    """Write a partitioned table and return :func:`qa_report` of it, counted on the way in the same pass.

    Counts are observed by the tasks that write, so a task that runs twice
    counts once. Seasons and reasons outside the lists are counted together,
    as one row without season and reason.
    """
    spark, seen = rows.sparkSession, Observation("qa")
    cells = [(s, r) for s in seasons for r in reasons]
    counts = [F.count_if((F.col(season) == s) & (F.col(reason) == r)).alias(f"n{i}") for i, (s, r) in enumerate(cells)]
    # Rows meet by partition before they are observed, so that no shuffle, whose tasks may run again, comes after.
    rows.hint("rebalance", season).observe(seen, F.count(F.lit(1)).alias("all"), *counts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(season).parquet(path)
    found = seen.get
    report = [(s, r, found[f"n{i}"]) for i, (s, r) in enumerate(cells) if found[f"n{i}"]]
    rest = found["all"] - sum(n for *_, n in report)
    return spark.createDataFrame([*report, *([(None, None, rest)] if rest else [])], "season int, reason string, n long")


def resolve_ids(rows: DataFrame, id_map: DataFrame, foreign: str, own: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a second source under our ids; (resolved with ``own``, quarantined with a reason).

    The map may be many-to-many and repeat pairs. Reasons: ``missing_id``, ``unmatched``,
    ``ambiguous`` (several of our ids), ``shared`` (its only id of ours is also another's only one, so rows could not be told apart).
    """
    pairs = id_map.select(F.col(foreign).alias("_f"), F.col(own).alias("_o")).dropna().distinct()
    by_foreign = pairs.groupBy("_f").agg(F.count("*").alias("_n"), F.min("_o").alias("_o"))
    claims = by_foreign.where("_n = 1").groupBy("_o").agg(F.count("*").alias("_claims"))
    known = by_foreign.join(claims, "_o", "left").select("_f", "_n", "_o", "_claims")
    out = rows.join(known, rows[foreign] == known["_f"], "left")
    reason = F.when(F.col(foreign).isNull(), "missing_id").when(F.col("_n").isNull(), "unmatched").when(F.col("_n") > 1, "ambiguous").when(F.col("_claims") > 1, "shared")
    out = out.withColumn("reason", reason)
    return out.where(F.col("reason").isNull()).select(*rows.columns, F.col("_o").alias(own)), out.where(F.col("reason").isNotNull()).select(*rows.columns, "reason")


def cell_disagreement(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float = 0.0) -> DataFrame:
    """By column: compared cells, mismatches and their share; a row that one side lacks mismatches in every cell."""
    a = left.select(*keys, F.lit(True).alias("_l"), *[F.col(c).cast("double").alias(f"l_{c}") for c in cols])
    b = right.select(*keys, F.lit(True).alias("_r"), *[F.col(c).cast("double").alias(f"r_{c}") for c in cols])
    both = a.join(b, list(keys), "full_outer")
    present = F.col("_l").isNotNull() & F.col("_r").isNotNull()

    def off(c: str) -> Column:
        x, y = F.col(f"l_{c}"), F.col(f"r_{c}")
        same = F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(F.abs(x - y) <= tol)
        return F.struct(F.lit(c).alias("stat"), (~(present & same)).cast("int").alias("bad"))

    cells = both.select(F.inline(F.array(*map(off, cols))))
    return cells.groupBy("stat").agg(F.count("*").alias("cells"), F.sum("bad").alias("mismatches"), F.avg("bad").alias("rate"))


def fill_gaps(primary: DataFrame, fallback: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The second source only where the first has no row or no value."""
    other = fallback.select(*keys, *[F.col(c).alias(f"_f_{c}") for c in cols])
    return primary.select(*keys, *cols).join(other, list(keys), "full_outer").select(*keys, *[F.coalesce(c, f"_f_{c}").alias(c) for c in cols])


def usage_share(players: DataFrame, keys: Sequence[str] = ("game_id", "team_id"), minutes: str = "minutes") -> DataFrame:
    """Adds ``usage_ppm``: a player's share of the team's plays while on the floor, in millionths, rounded down.

    Whole numbers keep later sums exact; null without minutes or team plays.
    """
    plays = 100 * F.col("fga") + 44 * F.col("fta") + 100 * F.col("tov")
    team = Window.partitionBy(*keys)
    out = players.withColumns({"_own": (plays * F.sum(minutes).over(team) * 1_000_000).cast("long"), "_all": (5 * F.col(minutes) * F.sum(plays).over(team)).cast("long")})
    return out.withColumn("usage_ppm", F.when(F.col("_all") > 0, F.expr("_own div _all"))).drop("_own", "_all")
