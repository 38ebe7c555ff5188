"""Schedule, place and biography features."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clipped, epoch_day, great_circle_miles
from ..sources.raw import work_dir


def team_games(games: DataFrame, home: str = "home_team", away: str = "away_team") -> DataFrame:
    """Two rows for each game: team_id, opp_id, is_home."""
    sides = [F.struct(F.col(a).alias("team_id"), F.col(b).alias("opp_id"), F.lit(h).alias("is_home")) for a, b, h in ((home, away, 1), (away, home, 0))]
    return games.select(*[c for c in games.columns if c not in (home, away)], F.inline(F.array(*sides)))


def schedule_load(df: DataFrame, entity: Sequence[str] = ("team_id",), date: str = "game_date") -> DataFrame:
    """rest_days (0 to 5), b2b, three_in_four, four_in_six; the last two count the target date, known from the schedule. Without a date: null, 0, 0, 0."""
    day = epoch_day(date)
    by = Window.partitionBy(*entity).orderBy(day)
    gap = day - F.max(day).over(by.rangeBetween(Window.unboundedPreceding, -1))
    last = lambda n: F.count(day).over(by.rangeBetween(-(n - 1), 0))
    return df.withColumns({"rest_days": clipped(gap, 0, 5), "b2b": F.coalesce((gap == 1).cast("int"), F.lit(0)), "three_in_four": (last(4) >= 3).cast("int"), "four_in_six": (last(6) >= 4).cast("int")})


def season_phase(df: DataFrame, schedule: DataFrame, season: str = "season", date: str = "game_date", playoffs: Column | None = None) -> DataFrame:
    """early, mid or late third of the season's dates, playoffs first. One row for each season is joined."""
    span = schedule.groupBy(season).agg(F.min(date).alias("_from"), F.max(date).alias("_to"))
    part = F.try_divide(F.datediff(date, "_from").cast("double"), F.datediff("_to", "_from"))
    third = F.when(3 * F.datediff(date, "_from") < F.datediff("_to", "_from"), "early").when(3 * F.datediff(date, "_from") < 2 * F.datediff("_to", "_from"), "mid").otherwise("late")
    phase = third if playoffs is None else F.when(playoffs, "playoffs").otherwise(third)
    return df.join(span, season, "left").withColumn("season_phase", F.when(part.isNull(), "early").otherwise(phase)).drop("_from", "_to")


def calendar(df: DataFrame, date: str = "game_date") -> DataFrame:
    """day_of_week (Monday 0) and month."""
    return df.withColumns({"day_of_week": F.weekday(date), "month": F.month(date)})


def with_arena(df: DataFrame, arenas: DataFrame, key: str = "home_team") -> DataFrame:
    """Left join of the arena table (one row for each team)."""
    return df.join(arenas, key, "left")


def travel_miles(df: DataFrame, entity: Sequence[str] = ("team_id",), date: str = "game_date", tiebreak: str = "game_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Great-circle miles from the arena of the last game of an earlier date; games without a date neither have nor are one."""
    day = epoch_day(date)
    before = Window.partitionBy(*entity).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    prev = F.max(F.when(day.isNotNull(), F.struct(day, F.col(tiebreak), F.col(lat).alias("lat"), F.col(lon).alias("lon")))).over(before)
    out = df.withColumn("_prev", F.when(day.isNotNull(), prev))
    return out.withColumn("travel_miles_prev", great_circle_miles(F.col("_prev.lat"), F.col("_prev.lon"), F.col(lat), F.col(lon))).drop("_prev")


def biography(df: DataFrame, info: DataFrame, date: str = "game_date", season: str = "season") -> DataFrame:
    """p_age, p_experience, p_height_in, p_weight_lbs as of the game date."""
    bio = info.select("player_id", "birthdate", "rookie_season", F.col("height_in").alias("p_height_in"), F.col("weight_lbs").alias("p_weight_lbs"))
    out = df.join(bio, "player_id", "left")
    return out.withColumns({"p_age": F.datediff(date, "birthdate") / F.lit(365.25), "p_experience": F.greatest(F.col(season) - F.col("rookie_season"), F.lit(0))}).drop("birthdate", "rookie_season")


def dense_entity_id(train: DataFrame, key: str, min_games: int = 10) -> DataFrame:
    """(key, dense_id): 1, 2, ... for entities with enough rows, 0 for the rest; from training rows only.

    The numbering is global, over one row for each entity; :func:`dense_entity_id_ranged` splits it.
    """
    counts = train.groupBy(key).agg(F.count("*").alias("_n"))
    enough = F.col("_n") >= min_games
    place = F.row_number().over(Window.partitionBy(enough).orderBy(key))
    return counts.select(key, F.when(enough, place).otherwise(0).alias("dense_id"))


def dense_entity_id_ranged(train: DataFrame, key: str, min_games: int = 10, ranges: int | None = None) -> DataFrame:
    """:func:`dense_entity_id` for any number of entities: numbered inside ranges of the key, plus the sizes of the ranges before.

    The ranges are written to the shared folder, since cutting them again
    might cut elsewhere; one number for each range reaches the driver. The
    folder belongs to whoever owns the shared one.
    """
    spark = train.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = train.groupBy(key).agg((F.count("*") >= min_games).alias("_enough"))
    at = work_dir(spark, "ranges")
    counts.repartitionByRange(ranges, F.desc("_enough"), key).withColumn("_range", F.spark_partition_id()).write.parquet(at)
    cut = spark.read.schema(counts.withColumn("_range", F.lit(0)).schema).parquet(at)
    sizes = {r["_range"]: r["n"] for r in cut.where("_enough").groupBy("_range").agg(F.count("*").alias("n")).collect()}
    starts = list(accumulate((sizes.get(i, 0) for i in range(ranges - 1)), initial=0))
    place = F.row_number().over(Window.partitionBy("_range", "_enough").orderBy(key)) + F.element_at(F.array(*map(F.lit, starts)), F.col("_range") + 1)
    return cut.select(key, F.when(F.col("_enough"), place).otherwise(0).cast("long").alias("dense_id"))
