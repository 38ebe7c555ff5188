"""Views that shape the star schema into games and box lines.

One SQL text serves Spark and the oracle: ``{orders}`` and ``{lineitem}`` are
the tables. A game is an order, a box line is a part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TEAM = "concat('T', lpad(cast({0} as varchar(9)), 2, '0'))"

CTES = f"""game as (
  select cast(o_orderkey as bigint) as game_id, cast(o_orderdate as date) as game_date, cast(year(cast(o_orderdate as date)) as int) as season,
         cast(o_custkey % 30 as bigint) as home_team, cast((o_custkey % 30 + 1 + o_orderkey % 29) % 30 as bigint) as away_team
  from {{orders}}),
base as (
  select l_orderkey as game_id, cast(l_partkey % 450 as bigint) as player_id,
         max(cast(floor(l_quantity) as bigint)) as q, max(cast(floor(l_extendedprice) as bigint)) as x,
         max(cast(round(l_discount * 100) as bigint)) as d, max(cast(round(l_tax * 100) as bigint)) as t,
         max(case when l_returnflag = 'R' and l_linestatus = 'O' then 1 else 0 end) as dnp_i
  from {{lineitem}} group by l_orderkey, l_partkey % 450),
pbox as (
  select g.game_id, g.game_date, g.season, b.player_id,
    case when b.player_id % 2 = 0 then g.home_team else g.away_team end as team_id,
    case when b.player_id % 2 = 0 then g.away_team else g.home_team end as opp_id,
    case when b.player_id % 2 = 0 then 1 else 0 end as is_home,
    case cast(b.player_id % 5 as int) when 0 then 'PG' when 1 then 'SG' when 2 then 'SF' when 3 then 'PF' else 'C' end as position,
    case when dnp_i = 1 then '' else concat(cast(q as varchar(9)), ':', lpad(cast(x % 60 as varchar(9)), 2, '0')) end as minutes_raw,
    case when dnp_i = 1 then 0 else q * 60 + x % 60 end as secs,
    case when dnp_i = 1 then 0 else cast(floor(q / 2.0) as bigint) end as fga,
    case when dnp_i = 1 then 0 else x % (cast(floor(q / 2.0) as bigint) + 1) end as fgm,
    case when dnp_i = 1 then 0 else cast(floor(x / 7.0) as bigint) % (cast(floor(q / 2.0) as bigint) + 1) end as tpa,
    case when dnp_i = 1 then 0 else least(x % (cast(floor(q / 2.0) as bigint) + 1), cast(floor(x / 7.0) as bigint) % (cast(floor(q / 2.0) as bigint) + 1)) end as tpm,
    case when dnp_i = 1 then 0 else d end as fta,
    case when dnp_i = 1 then 0 else x % (d + 1) + case when t = 8 and x % 11 = 0 then d + 1 else 0 end end as ftm,
    case when dnp_i = 1 then 0 else t % 5 end as oreb, case when dnp_i = 1 then 0 else d end as dreb,
    case when dnp_i = 1 then 0 else t % 5 + d + case when x % 97 = 0 then 1 else 0 end end as reb,
    case when dnp_i = 1 then 0 else x % 12 end as ast, case when dnp_i = 1 then 0 else x % 4 end as stl, case when dnp_i = 1 then 0 else x % 3 end as blk,
    case when dnp_i = 1 then 0 else x % 6 end as tov, case when dnp_i = 1 then 0 else x % 7 end as pf
  from base b join game g on g.game_id = b.game_id),
tbox as (
  select game_id, game_date, season, team_id, opp_id, is_home, cast(sum(secs) as bigint) as secs, cast(sum(2 * fgm + tpm + ftm) as bigint) as pts,
         cast(sum(fga) as bigint) as fga, cast(sum(fgm) as bigint) as fgm, cast(sum(tpm) as bigint) as tpm, cast(sum(fta) as bigint) as fta, cast(sum(oreb) as bigint) as oreb,
         cast(sum(tov) as bigint) as tov, cast(count(*) as bigint) as n_players
  from pbox group by game_id, game_date, season, team_id, opp_id, is_home),
raw_game as (
  select concat(case when month(game_date) = 6 then '4' else '2' end, cast(season as varchar(9))) as SEASON_ID, home_team as TEAM_ID, {_TEAM.format("home_team")} as TEAM_ABBREVIATION,
         lpad(cast(game_id as varchar(20)), 10, '0') as GAME_ID, cast(game_date as varchar(10)) as GAME_DATE,
         concat({_TEAM.format("home_team")}, ' vs. ', {_TEAM.format("away_team")}) as MATCHUP, 'W' as WL,
         case when game_id % 91 = 0 then null else cast(80 + game_id % 60 as int) end as PTS, cast(240 + case when game_id % 7 = 0 then 25 else 0 end as int) as MIN
  from game
  union all
  select concat('2', cast(season as varchar(9))), away_team, {_TEAM.format("away_team")}, lpad(cast(game_id as varchar(20)), 10, '0'), cast(game_date as varchar(10)),
         concat({_TEAM.format("away_team")}, case when game_id % 77 = 0 then ' vs. ' else ' @ ' end, {_TEAM.format("home_team")}), 'L', cast(70 + game_id % 50 as int), cast(240 as int)
  from game where game_id % 50 <> 0),
raw_player as (
  select lpad(cast(game_id as varchar(20)), 10, '0') as gameId, team_id as teamId, {_TEAM.format("team_id")} as teamTricode, player_id as personId, concat('P', cast(player_id as varchar(9))) as firstName,
         case when player_id % 10 = 0 then '' else concat('Q', cast(player_id % 7 as varchar(9))) end as familyName, case when secs >= 1500 then position else '' end as position,
         case when secs = 0 and player_id % 3 = 0 then 'Inactive - rest' else '' end as comment, minutes_raw as minutes,
         case when secs = 0 then null else fgm end as fieldGoalsMade, case when secs = 0 then null else fga end as fieldGoalsAttempted, tpm as threePointersMade, tpa as threePointersAttempted,
         ftm as freeThrowsMade, fta as freeThrowsAttempted, oreb as reboundsOffensive, dreb as reboundsDefensive, reb as reboundsTotal, ast as assists, stl as steals, blk as blocks, tov as turnovers, pf as foulsPersonal,
         2 * fgm + tpm + ftm as points, 'extra' as unknown_field
  from pbox)"""

#: Prefix of an oracle query over the views.
ORACLE_WITH = "with " + CTES.format(orders="orders", lineitem="lineitem")


#: Whole numbers halved and divided by seven without decimals, which cost more than the rest of a view; both round down.
_CTES = CTES.replace("cast(floor(q / 2.0) as bigint)", "shiftright(q, 1)").replace("cast(floor(x / 7.0) as bigint)", "((x - pmod(x, 7)) div 7)")

#: Lines of a task; what a task keeps in memory does not grow with the tables.
TASK_LINES = 150_000


def _by_game(orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt by game, with the same columns for every view: what follows by game, or by its teams and players, needs no further shuffle, and a query that uses views several times deals once."""
    spark, n = lineitem.sparkSession, lineitem.count()  # from the files' footers
    parts = max(1, -(-n // TASK_LINES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 20_000))
    lines = lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return orders.select("o_orderkey", "o_custkey", "o_orderdate").repartition(parts, "o_orderkey"), lines.repartition(parts, "l_orderkey")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of game, pbox, tbox, raw_game, raw_player."""
    orders, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    if not name.endswith("game"):
        orders, lineitem = _by_game(orders, lineitem)
    return spark.sql(f"with {_CTES} select * from {name}", orders=orders, lineitem=lineitem)
