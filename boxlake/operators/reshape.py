"""Rollups, splits, rosters and padded rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_day


def team_rollup(players: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return players.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])


def residuals_by_segment(df: DataFrame, residuals: Sequence[str], segments: Sequence[str]) -> DataFrame:
    """Mean residual of every stat by each segment, in one pass over grouping sets."""
    long = df.select(*segments, F.inline(F.array(*[F.struct(F.lit(r).alias("stat"), F.col(r).cast("double").alias("_r")) for r in residuals])))
    sets = [[F.col("stat"), F.col(s)] for s in segments]
    agg = long.groupingSets(sets, F.col("stat"), *map(F.col, segments)).agg(F.avg("_r").alias("mean_residual"), F.count("_r").alias("n"), F.grouping_id().alias("_g"))
    width = len(segments)
    segment = F.coalesce(*[F.when(F.col("_g").bitwiseAND(1 << (width - 1 - i)) == 0, F.lit(s)) for i, s in enumerate(segments)])
    level = F.coalesce(*[F.when(F.col("_g").bitwiseAND(1 << (width - 1 - i)) == 0, F.col(s).cast("string")) for i, s in enumerate(segments)])
    return agg.select("stat", segment.alias("segment"), level.alias("level"), "mean_residual", "n")


def group_means(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"{c}_mean") for c in cols], F.count("*").alias("n"))


def union_seasons(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def assign_split(df: DataFrame, spec: Mapping[str, Sequence[int]], season: str = "season") -> DataFrame:
    """``split`` by season; seasons outside every split are null."""
    seen: dict[int, str] = {}
    for name, seasons in spec.items():
        for s in seasons:
            if seen.setdefault(s, name) != name:
                raise ValueError(f"season {s} is in two splits")
    split = F.lit(None).cast("string")
    for name, seasons in spec.items():
        split = F.when(F.col(season).isin(list(seasons)), F.lit(name)).otherwise(split)
    return df.withColumn("split", split)


def season_overlap(df: DataFrame, season: str = "season", split: str = "split") -> DataFrame:
    """Seasons that occur in more than one split."""
    return df.groupBy(season).agg(F.countDistinct(split).alias("n_splits")).where(F.col("n_splits") > 1)


def assert_no_season_overlap(df: DataFrame, season: str = "season", split: str = "split") -> None:
    if (row := season_overlap(df, season, split).first()) is not None:
        raise AssertionError(f"season {row[season]} is in {row.n_splits} splits")


def latest_roster(box: DataFrame, as_of: Column, size: int = 15, team: str = "team_id", player: str = "player_id", date: str = "game_date", game: str = "game_id", rank: str = "secs") -> DataFrame:
    """Players of each team's last game before a date, the ``size`` with most playing time."""
    past = box.where(F.col(date) < as_of)
    last = past.groupBy(team).agg(F.max_by(F.col(game), F.struct(date, game)).alias(game))
    rows = past.join(last, [team, game], "left_semi")
    place = F.row_number().over(Window.partitionBy(team).orderBy(F.desc(rank), player))
    return rows.withColumn("place", place).where(F.col("place") <= size).select(team, player, game, date, "place")


def sample_games(df: DataFrame, k: int, order: Column, key: str = "game_id") -> DataFrame:
    """``k`` reproducible games by an order that looks random, e.g. a hash of id and seed."""
    return df.orderBy(order, key).limit(k)


def seeded(key: str, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def resolve_players(requested: DataFrame, info: DataFrame, request: str = "request") -> DataFrame:
    """Requests (an id or a name) with player_id, name, n_matches and status matched, ambiguous or unmatched."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    asked = requested.select(request).distinct().withColumns({"_id": F.col(request).try_cast("long"), "_name": norm(F.col(request))})
    people = info.select("player_id", "name").distinct()
    by_id = asked.join(people.select(F.col("player_id").alias("_id"), F.col("name").alias("n1")), "_id", "left").select(request, "_name", F.when(F.col("n1").isNotNull(), F.struct(F.col("_id").alias("player_id"), F.col("n1").alias("name"))).alias("a"))
    by_name = by_id.join(people.select(norm(F.col("name")).alias("_name"), F.struct("player_id", "name").alias("b")), "_name", "left")
    found = by_name.select(request, F.coalesce("a", "b").alias("p")).distinct().groupBy(request).agg(F.count("p").alias("n_matches"), F.min("p").alias("p"))
    status = F.when(F.col("n_matches") == 0, "unmatched").when(F.col("n_matches") == 1, "matched").otherwise("ambiguous")
    only = F.when(F.col("n_matches") == 1, F.col("p"))
    return found.select(request, "n_matches", status.alias("status"), only["player_id"].alias("player_id"), only["name"].alias("name"))


def assemble_game_rows(box: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[str], size: int = 15) -> DataFrame:
    """One row for each key: ``players`` of fixed length and ``mask``; rosters are ranked before they are gathered."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    top = box.withColumn("_place", place).where(F.col("_place") <= size)
    rows = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", *fields))).alias("_rows"))
    slots = F.sequence(F.lit(1), F.lit(size))
    players = F.transform(slots, lambda i: F.get("_rows", i - 1)).alias("players")
    return rows.select(*keys, players, F.transform(slots, lambda i: i <= F.size("_rows")).alias("mask"))


def explode_game_rows(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The inverse; padding goes."""
    flat = rows.select(*keys, F.posexplode(F.arrays_zip("players", "mask")).alias("slot", "_x")).where("_x.mask")
    return flat.select(*keys, "slot", *[F.col(f"_x.players.{f}").alias(f) for f in fields])
