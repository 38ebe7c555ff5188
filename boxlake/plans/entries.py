"""One query and one oracle text for each operator of the blueprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import scalar
from ..operators import baseline, beta, blocks, checks, context, etl, joins, matchup, metrics, reshape, rolling, sketches
from ..sources import raw
from .bridge import ORACLE_WITH, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPLITS = {"train": [1995, 1996, 1997, 1998, 1999], "val": [2000], "test": [2001]}


def query(sql: str | None = None, with_views: bool = True) -> Callable[[Query], Query]:
    """Register a query with its oracle; ``sql`` follows the views' common table expressions."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            ORACLES[f.__name__] = (ORACLE_WITH + (", " + body[5:] if body.startswith("with ") else " " + body)) if with_views else body
        return f

    return register


def points() -> Column:
    return F.expr("2 * fgm + tpm + ftm")


def played() -> Column:
    return F.col("secs") > 0


def train() -> Column:
    return F.col("season") <= 1999


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sources and sinks


@query("""select cast(game_id as varchar) as GAME_ID, cast(team_id as bigint) as TEAM_ID, cast(pts as int) as PTS, cast(null as varchar) as WL
  from (select GAME_ID as game_id, TEAM_ID as team_id, PTS as pts from raw_game)""")
def src1_read_raw(spark, sf_dir):
    root = raw.work_dir(spark, ".cache")
    for n in (0, 1):  # the second data set must not be read
        view(spark, sf_dir, "raw_game").drop("WL").write.parquet(f"{root}-w{n}")
        raw.move_payloads(spark, f"{root}-w{n}", f"{root}/leaguegamelog", n)
    return raw.read_raw(spark, root, "leaguegamelog", "games", schemas.RAW_GAME).select("GAME_ID", "TEAM_ID", "PTS", "WL")


@query("""select gameId as "gameId", cast(points as int) as points, cast(fieldGoalsMade as int) as "fieldGoalsMade", cast(null as double) as "plusMinusPoints" from raw_player""")
def src2_conform(spark, sf_dir):
    return raw.conform(view(spark, sf_dir, "raw_player"), schemas.RAW_PLAYER_BOX).select("gameId", "points", "fieldGoalsMade", "plusMinusPoints")


@query("select 'games' as endpoint, true as all_files, cast(count(*) as bigint) as rows, true as has_bytes from raw_game")
def src3_raw_inventory(spark, sf_dir):
    root = raw.work_dir(spark, "inventory")
    view(spark, sf_dir, "raw_game").write.parquet(f"{root}/games")
    written = spark.read.parquet(f"{root}/games")
    return raw.raw_inventory(written).select("endpoint", (F.col("files") == len(written.inputFiles())).alias("all_files"), "rows", (F.col("bytes") > 0).alias("has_bytes"))


@query("""select user_id, event_type, event_id, value from (
  select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1""", with_views=False)
def src4_latest_snapshot(spark, sf_dir):
    return raw.latest_snapshot(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""select event_id, left(sha256(concat_ws('|', coalesce('=' || event_type, '-'), coalesce('=' || cast(user_id as varchar), '-'))), 16) as request_key from events""", with_views=False)
def src5_request_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.request_key(F.col("event_type"), F.col("user_id")).alias("request_key"))


@query("select season, lpad(cast(game_id as varchar), 10, '0') as game_id, player_id, secs from pbox")
def snk1_write_interim(spark, sf_dir):
    path = raw.work_dir(spark, "interim")
    rows = view(spark, sf_dir, "pbox").select("season", F.lpad(F.col("game_id").cast("string"), 10, "0").alias("game_id"), "player_id", "secs")
    raw.write_interim(rows, path)
    raw.write_interim(rows.where("season = 1996"), path)  # once more: one season is replaced, the rest stays
    return spark.read.schema(rows.schema).parquet(path).select("season", "game_id", "player_id", "secs")


@query("""select case when season <= 1999 then 'train' when season = 2000 then 'val' else 'test' end as split, cast(count(*) as bigint) as n from game
  where season between 1995 and 2001 group by 1""")
def snk2_write_splits(spark, sf_dir):
    path = raw.work_dir(spark, "splits")
    raw.write_splits(reshape.assign_split(view(spark, sf_dir, "game"), SPLITS).where(F.col("split").isNotNull()), path)
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("n"))


# --- raw to typed tables


@query("""select game_id, player_id, minutes_raw, round(case when minutes_raw = '' then 0.0 else cast(split_part(minutes_raw, ':', 1) as int) + cast(split_part(minutes_raw, ':', 2) as int) / 60.0 end, 6) as minutes
  from (select game_id, player_id, minutes_raw from pbox)""")
def etl1_parse_mmss(spark, sf_dir):
    return rounded(view(spark, sf_dir, "pbox").select("game_id", "player_id", "minutes_raw", scalar.parse_mmss(F.col("minutes_raw")).alias("minutes")), "minutes")


@query("select distinct season, cast(season as varchar) || '-' || lpad(cast((season + 1) % 100 as varchar), 2, '0') as label from game")
def etl2_season_label(spark, sf_dir):
    return view(spark, sf_dir, "game").select("season", scalar.season_label(F.col("season")).alias("label")).distinct()


@query("""select distinct SEASON_ID as season_id, cast(right(SEASON_ID, 4) as int) as season, case left(SEASON_ID, 1) when '4' then 'playoffs' else 'regular' end as kind from raw_game""")
def etl3_season_from_id(spark, sf_dir):
    c = F.col("SEASON_ID")
    return view(spark, sf_dir, "raw_game").select(c.alias("season_id"), scalar.season_from_id(c).alias("season"), scalar.season_kind(c).alias("kind")).distinct()


@query("""with g as (select GAME_ID as k, count(*) as n, count(*) filter (where contains(MATCHUP, 'vs.')) as nh from raw_game group by 1),
  ok as (select k from g where n = 2 and nh = 1)
  select h.GAME_ID as game_id, cast(right(h.SEASON_ID, 4) as int) as season, cast(h.GAME_DATE as date) as date, h.TEAM_ID as home_team_id, a.TEAM_ID as away_team_id,
    coalesce(h.PTS, 0) as home_pts, coalesce(a.PTS, 0) as away_pts, h.MIN > 240 as is_overtime, left(h.SEASON_ID, 1) = '4' as is_playoffs
  from raw_game h join raw_game a on h.GAME_ID = a.GAME_ID and contains(h.MATCHUP, 'vs.') and not contains(a.MATCHUP, 'vs.') where h.GAME_ID in (select k from ok)""")
def etl4_build_games(spark, sf_dir):
    games, _ = etl.build_games(view(spark, sf_dir, "raw_game"))
    return games.select("game_id", "season", "date", "home_team_id", "away_team_id", "home_pts", "away_pts", "is_overtime", "is_playoffs")


@query("""select GAME_ID as game_id, cast(count(*) as bigint) as n, case when count(*) <> 2 then 'row_count' else 'ambiguous_home' end as reason from raw_game group by GAME_ID
  having count(*) <> 2 or count(*) filter (where contains(MATCHUP, 'vs.')) <> 1""")
def etl4_rejected(spark, sf_dir):
    return etl.build_games(view(spark, sf_dir, "raw_game"))[1].select(F.col("GAME_ID").alias("game_id"), "n", "reason")


@query("""select gameId as game_id, personId as player_id, trim(concat_ws(' ', firstName, familyName)) as player_name, coalesce(cast(fieldGoalsMade as int), 0) as fgm, cast(points as int) as pts,
    position <> '' as is_starter, comment not like 'Inactive%' as is_active, minutes in ('', '0:00') as dnp from raw_player""")
def etl5_player_box(spark, sf_dir):
    rows = etl.player_box_from_raw(raw.conform(view(spark, sf_dir, "raw_player"), schemas.RAW_PLAYER_BOX))
    return rows.select("game_id", "player_id", "player_name", "fgm", "pts", "is_starter", "is_active", "dnp")


def _team_lines(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    teams = view(spark, sf_dir, "tbox").select(
        F.lpad(F.col("game_id").cast("string"), 10, "0").alias("gameId"), F.col("team_id").alias("teamId"), F.concat((F.col("secs") / 60).cast("bigint").cast("string"), F.lit(":"), F.lpad((F.col("secs") % 60).cast("string"), 2, "0")).alias("minutes"),
        F.col("pts").alias("points"), F.col("fga").alias("fieldGoalsAttempted"), F.col("fgm").alias("fieldGoalsMade"), F.col("fta").alias("freeThrowsAttempted"), F.col("oreb").alias("reboundsOffensive"), F.col("tov").alias("turnovers"))
    return raw.conform(teams, schemas.RAW_TEAM_BOX), etl.build_games(view(spark, sf_dir, "raw_game"))[0]


_OK_GAMES = "ok as (select GAME_ID as k, max(case when contains(MATCHUP, 'vs.') then TEAM_ID end) as home, max(case when contains(MATCHUP, 'vs.') then MIN end) > 240 as ot from raw_game group by 1 having count(*) = 2 and count(*) filter (where contains(MATCHUP, 'vs.')) = 1)"


@query(f"""with {_OK_GAMES} select k as game_id, team_id, cast(pts as int) as pts, cast(fga as int) as fga, cast(0 as int) as ast, team_id = home as is_home, round(secs / 60.0, 6) as minutes
  from tbox join ok on lpad(cast(game_id as varchar), 10, '0') = k""")
def etl6_team_box(spark, sf_dir):
    return rounded(etl.team_box_from_raw(*_team_lines(spark, sf_dir)).select("game_id", "team_id", "pts", "fga", "ast", "is_home", "minutes"), "minutes")


@query("""select t.game_id, t.team_id, t.pts, case when t.game_id % 3 = 0 then cast(t.fga + t.tov as double) end as pace from tbox t""")
def etl7_merge_advanced(spark, sf_dir):
    t = view(spark, sf_dir, "tbox")
    adv = t.where("game_id % 3 = 0").select("game_id", "team_id", (F.col("fga") + F.col("tov")).cast("double").alias("pace"))
    return etl.merge_advanced(t.select("game_id", "team_id", "pts"), adv, cols=["pace"])


@query("""select game_id, team_id, round(case when fga + 0.44 * fta > 0 then pts / (2 * (fga + cast(0.44 as double) * fta)) end, 6) as ts_pct, round(case when fga > 0 then (fgm + 0.5 * tpm) / fga end, 6) as efg_pct,
    round(fga + cast(0.44 as double) * fta - oreb + tov, 6) as poss, round(case when fga + cast(0.44 as double) * fta - oreb + tov <> 0 then 100.0 * pts / (fga + cast(0.44 as double) * fta - oreb + tov) end, 6) as off_rtg from tbox""")
def etl8_advanced(spark, sf_dir):
    out = etl.advanced_from_traditional(view(spark, sf_dir, "tbox"))
    return rounded(out.select("game_id", "team_id", "ts_pct", "efg_pct", "poss", "off_rtg"), "ts_pct", "efg_pct", "poss", "off_rtg")


@query("""with r as (select game_id, team_id, case when fga + cast(0.44 as double) * fta - oreb + tov <> 0 then 100.0 * pts / (fga + cast(0.44 as double) * fta - oreb + tov) end as o from tbox)
  select a.game_id, a.team_id, round(b.o, 6) as def_rtg from r a left join r b on a.game_id = b.game_id and a.team_id <> b.team_id""")
def etl9_def_rtg(spark, sf_dir):
    out = etl.def_rtg_from_opponent(etl.advanced_from_traditional(view(spark, sf_dir, "tbox")))
    return rounded(out.select("game_id", "team_id", "def_rtg"), "def_rtg")


@query("select game_id, player_id, 2 * fgm + tpm + ftm as pts, oreb + dreb as reb from pbox")
def etl10_derive_points(spark, sf_dir):
    return etl.derive_points(view(spark, sf_dir, "pbox")).select("game_id", "player_id", "pts", "reb")


@query("select team_id, season, list_sort(list(distinct player_id)) as player_ids from pbox group by team_id, season")
def etl11_roster(spark, sf_dir):
    packed = etl.normalize_roster(view(spark, sf_dir, "pbox").select("team_id", "season", "player_id"))
    return etl.normalize_roster(etl.roster_rows(packed))


@query("""select s_suppkey as player_id, trim(s_name) as name, cast('1980-01-01' as date) + cast(s_suppkey % 9000 as int) as birthdate, cast(70 + s_nationkey % 20 as double) as height_in,
    case s_nationkey % 4 when 0 then 'SF' when 1 then 'SG' when 2 then 'PF' else null end as position, cast(1995 + s_suppkey % 7 as int) as rookie_season from supplier""", with_views=False)
def etl12_player_info(spark, sf_dir):
    return etl.clean_player_info(_player_info(spark, sf_dir)).select("player_id", "name", "birthdate", "height_in", "position", "rookie_season")


def _player_info(spark, sf_dir) -> DataFrame:
    """Raw biography text rows from suppliers."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("player_id"), F.concat(F.lit(" "), "s_name").alias("name"), F.date_add(F.lit("1980-01-01").cast("date"), (F.col("s_suppkey") % 9000).cast("int")).cast("string").alias("birthdate"),
        (F.col("s_nationkey") % 20 + 70).cast("string").alias("height_in"), F.lit("n/a").alias("weight_lbs"), F.element_at(F.array(*map(F.lit, ["F", "g ", "F-C", "?"])), (F.col("s_nationkey") % 4 + 1).cast("int")).alias("position"),
        F.lit(None).cast("string").alias("draft_year"), (F.col("s_suppkey") % 7 + 1995).cast("string").alias("rookie_season"))


_DROPPED = f"""with {_OK_GAMES}, odd as (select lpad(cast(game_id as varchar), 10, '0') as k, max(case when abs(secs / 60.0 - 240) > 0.1 then 1 else 0 end) as odd from tbox group by 1),
  fl as (select ok.k as game_id, case when ot then 'overtime' when coalesce(odd, 0) = 1 then 'minutes' end as dropped_reason from ok left join odd on ok.k = odd.k)"""


def _flagged(spark, sf_dir) -> DataFrame:
    lines, games = _team_lines(spark, sf_dir)
    return etl.flag_dropped(games, etl.team_box_from_raw(lines, games))


@query(_DROPPED + " select game_id, dropped_reason, dropped_reason is not null as dropped from fl")
def etl13_flag_dropped(spark, sf_dir):
    return _flagged(spark, sf_dir).select("game_id", "dropped_reason", "dropped")


@query(_DROPPED + " select game_id from fl where coalesce(dropped_reason, '') <> 'overtime'")
def etl14_filters(spark, sf_dir):
    return etl.apply_filters(_flagged(spark, sf_dir), exclude_short_games=False).select("game_id")


@query("select gameId as game_id, personId as player_id from raw_player where comment not like 'Inactive%'")
def etl15_active_roster(spark, sf_dir):
    return etl.active_roster(etl.player_box_from_raw(raw.conform(view(spark, sf_dir, "raw_player"), schemas.RAW_PLAYER_BOX))).select("game_id", "player_id")


def _rejected(spark, sf_dir) -> DataFrame:
    return etl.build_games(view(spark, sf_dir, "raw_game"))[1].withColumn("season", F.left("first_date", F.lit(4)).cast("int"))


_QA = """select cast(substr(GAME_DATE, 1, 4) as int) as season, reason, cast(count(*) as bigint) as n from (
    select min(GAME_DATE) as GAME_DATE, case when count(*) <> 2 then 'row_count' else 'ambiguous_home' end as reason from raw_game group by GAME_ID
    having count(*) <> 2 or count(*) filter (where contains(MATCHUP, 'vs.')) <> 1) group by 1, 2"""


@query(_QA)
def etl16_qa_report(spark, sf_dir):
    return etl.qa_report(_rejected(spark, sf_dir))


@query(_QA)
def etl16_observed_report(spark, sf_dir):
    """Counted while the rejected games are written."""
    return etl.write_with_report(_rejected(spark, sf_dir), raw.work_dir(spark, "rejected"), range(1990, 2005), ["row_count", "ambiguous_home", "missing_game_id"])


@query("""select s as stat, cast(count(*) as bigint) as cells, cast(sum(bad) as bigint) as mismatches, round(avg(bad), 6) as rate from (
    select 'ast' as s, case when game_id % 50 = 0 then 1 else 0 end as bad from pbox union all select 'stl', 0 from pbox) group by s""")
def etl17_cell_disagreement(spark, sf_dir):
    p = view(spark, sf_dir, "pbox").select("game_id", "player_id", "ast", "stl")
    other = p.withColumn("ast", F.col("ast") + (F.col("game_id") % 50 == 0).cast("int"))
    return rounded(etl.cell_disagreement(p, other, ["game_id", "player_id"], ["ast", "stl"]), "rate")


@query("select game_id, player_id, case when game_id % 4 = 0 then ast + 1 else ast end as ast from pbox where not (game_id % 5 = 0 and game_id % 4 <> 0)")
def etl18_fill_gaps(spark, sf_dir):
    p = view(spark, sf_dir, "pbox").select("game_id", "player_id", "ast")
    first = p.where("game_id % 5 <> 0").withColumn("ast", F.when(F.col("game_id") % 4 != 0, F.col("ast")))
    second = p.where("game_id % 4 = 0").withColumn("ast", F.col("ast") + 1)
    return etl.fill_gaps(first, second, ["game_id", "player_id"], ["ast"])


_MAP = """m as (select distinct 'b' || cast(s_suppkey % 60 as varchar) as ref_id, s_suppkey as player_id from supplier where s_suppkey % 60 >= 20 union select 'b' || cast(c_custkey + 200 as varchar), c_custkey % 90 from customer where c_custkey <= 120),
  f as (select ref_id, count(*) as k, min(player_id) as o from m group by 1), cl as (select o, count(*) as c from f where k = 1 group by 1),
  s as (select game_id, case when game_id % 11 = 0 then null else 'b' || cast(player_id as varchar) end as ref_id, ast + 1 as ast from pbox where game_id % 4 = 0),
  r as (select s.*, f.o as player_id, case when s.ref_id is null then 'missing_id' when k is null then 'unmatched' when k > 1 then 'ambiguous' when c > 1 then 'shared' end as reason from s left join f on s.ref_id = f.ref_id left join cl on f.o = cl.o)"""


def _second_source(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lines of a second source that names players by ids of its own, and the map of these, which repeats, lacks and doubles some."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer").where("c_custkey <= 120")
    ids = s.where("s_suppkey % 60 >= 20").selectExpr("concat('b', cast(s_suppkey % 60 as string)) as ref_id", "s_suppkey as player_id").unionAll(c.selectExpr("concat('b', cast(c_custkey + 200 as string)) as ref_id", "c_custkey % 90 as player_id"))
    lines = view(spark, sf_dir, "pbox").where("game_id % 4 = 0").selectExpr("game_id", "case when game_id % 11 <> 0 then concat('b', cast(player_id as string)) end as ref_id", "ast + 1 as ast")
    return lines, ids.unionAll(ids)


@query(f"with {_MAP} select game_id, ref_id, ast, reason from r where reason is not null")
def etl18_unresolved(spark, sf_dir):
    return etl.resolve_ids(*_second_source(spark, sf_dir), "ref_id", "player_id")[1].select("game_id", "ref_id", "ast", "reason")


@query(f"with {_MAP}, a as (select game_id, player_id, case when game_id % 3 <> 0 then ast end as ast from pbox where game_id % 5 <> 0), b as (select game_id, player_id, ast from r where reason is null) "
       "select coalesce(a.game_id, b.game_id) as game_id, coalesce(a.player_id, b.player_id) as player_id, coalesce(a.ast, b.ast) as ast from a full join b on a.game_id = b.game_id and a.player_id = b.player_id")
def etl18_fill_gaps_by_map(spark, sf_dir):
    """Gaps filled from a second source under its own ids."""
    first = view(spark, sf_dir, "pbox").where("game_id % 5 <> 0").select("game_id", "player_id", F.when(F.col("game_id") % 3 != 0, F.col("ast")).alias("ast"))
    resolved, _ = etl.resolve_ids(*_second_source(spark, sf_dir), "ref_id", "player_id")
    return etl.fill_gaps(first, resolved.select("game_id", "player_id", "ast"), ["game_id", "player_id"], ["ast"])


# --- constraint checks

_BOX_COUNTS = [c for c in schemas.COUNTS if c != "pts"]
_BAD = "case when {0} then 1 else 0 end"


def _box_checks() -> dict:
    return checks.box_checks(_BOX_COUNTS, minutes="secs", dnp="dnp")


def _box(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "pbox").withColumn("dnp", F.col("minutes_raw") == "")


@query("""select game_id, player_id, concat_ws(',', case when ftm > fta then 'ftm_le_fta' end, case when oreb + dreb <> reb then 'reb_sum' end, case when (minutes_raw = '') <> (secs = 0) then 'dnp_minutes' end) as violations
  from pbox where fgm > fga or tpm > tpa or ftm > fta or tpm > fgm or tpa > fga or oreb + dreb <> reb or (minutes_raw = '') <> (secs = 0)""")
def ck1_8_rejected(spark, sf_dir):
    _, rejected = checks.validate(_box(spark, sf_dir), _box_checks())
    return rejected.select("game_id", "player_id", F.concat_ws(",", "violations").alias("violations"))


@query("select cast(count(*) as bigint) as n, cast(sum(reb) as bigint) as reb from pbox where ftm <= fta and oreb + dreb = reb and (minutes_raw = '') = (secs = 0)")
def ck1_8_valid(spark, sf_dir):
    valid, _ = checks.validate(_box(spark, sf_dir), _box_checks())
    return valid.agg(F.count("*").alias("n"), F.sum("reb").alias("reb"))


@query("select game_id, team_id, cast(sum(secs) as bigint) as total, abs(sum(secs) - 14400) <= 6 as ok from pbox group by game_id, team_id")
def ck9_minutes_sum(spark, sf_dir):
    return checks.minutes_sum(view(spark, sf_dir, "pbox"), ["game_id", "team_id"], "secs", 14400, 6)


@query("select game_id, team_id, case when game_id % 13 = 0 then 'fga' else '' end as violations from tbox")
def ck10_team_totals(spark, sf_dir):
    teams = view(spark, sf_dir, "tbox").select("game_id", "team_id", (F.col("fga") + (F.col("game_id") % 13 == 0).cast("int")).alias("fga"), "tov")
    out = checks.team_totals_match(view(spark, sf_dir, "pbox"), teams, ["game_id", "team_id"], ["fga", "tov"])
    return out.select("game_id", "team_id", F.concat_ws(",", "violations").alias("violations"))


@query("select cast(count(*) as bigint) as n_dnp, cast(count(*) filter (where secs + game_id % 29 // 28 <> 0) as bigint) as n_bad from pbox where minutes_raw = ''")
def ck11_dnp_minutes(spark, sf_dir):
    """With a minute too many in every 29th game."""
    box = _box(spark, sf_dir).withColumn("secs", F.col("secs") + F.when(F.col("game_id") % 29 == 28, 1).otherwise(0))
    marked = checks.with_violations(box.where("dnp"), checks.absence_checks(minutes="secs"))
    return marked.agg(F.count("*").alias("n_dnp"), F.count_if(F.size("violations") > 0).alias("n_bad"))


_SPOILT = """select game_id, player_id, team_id, fgm, fga, tpm, case when game_id % 17 = 0 then tpm - 1 when game_id % 19 = 0 then fga + 1 else tpa end as tpa, ftm, fta, oreb, dreb, reb,
    case when game_id % 23 = 0 then ast + cast(0.5 as double) else cast(ast as double) end as ast, stl, blk, tov, pf, secs, minutes_raw from pbox"""
_NAMES = """concat_ws(',', case when fgm > fga then 'fgm_le_fga' end, case when tpm > tpa then 'tpm_le_tpa' end, case when ftm > fta then 'ftm_le_fta' end, case when tpm > fgm then 'tpm_le_fgm' end,
    case when tpa > fga then 'tpa_le_fga' end, case when oreb + dreb <> reb then 'reb_sum' end, case when tpa < 0 then 'non_negative' end, case when ast <> floor(ast) then 'integral' end{0})"""


def _spoilt(spark, sf_dir) -> DataFrame:
    """Box lines that break the checks which the views' own lines keep."""
    g = F.col("game_id")
    tpa = F.when(g % 17 == 0, F.col("tpm") - 1).when(g % 19 == 0, F.col("fga") + 1).otherwise(F.col("tpa"))
    return _box(spark, sf_dir).withColumns({"tpa": tpa, "ast": F.col("ast").cast("double") + F.when(g % 23 == 0, 0.5).otherwise(0.0)})


@query(f"with s as ({_SPOILT}), v as (select game_id, player_id, {_NAMES.format("")} as violations from s) select * from v where violations <> ''")
def ck2_5_8_rejected(spark, sf_dir):
    _, rejected = checks.validate(_spoilt(spark, sf_dir), _box_checks())
    return rejected.select("game_id", "player_id", F.concat_ws(",", "violations").alias("violations"))


@query(f"""with s as ({_SPOILT}), t as (select game_id, team_id, {", ".join(f"sum({c}) as {c}" for c in _BOX_COUNTS)} from s group by game_id, team_id),
  v as (select game_id, team_id, {_NAMES.format("")} as violations from t) select * from v where violations <> ''""")
def ck_team_rejected(spark, sf_dir):
    teams = reshape.team_rollup(_spoilt(spark, sf_dir), ["game_id", "team_id"], [*_BOX_COUNTS, "secs"])
    _, rejected = checks.validate(teams, checks.team_checks(_BOX_COUNTS, "secs"))
    return rejected.select("game_id", "team_id", F.concat_ws(",", "violations").alias("violations"))


@query("""with u as (select game_id, max(case when ftm > fta then 1 else 0 end) as f, max(case when oreb + dreb <> reb then 1 else 0 end) as r from pbox group by game_id),
  l as (select 'ftm_le_fta' as "check", f as bad from u union all select 'reb_sum', r from u union all select 'any', greatest(f, r) from u)
  select "check", cast(count(*) as bigint) as units, cast(sum(bad) as bigint) as bad_units, round(avg(bad), 6) as rate from l group by 1""")
def ck12_violation_rate(spark, sf_dir):
    some = {k: v for k, v in _box_checks().items() if k in ("ftm_le_fta", "reb_sum")}
    return rounded(checks.constraint_violation_rate(_box(spark, sf_dir), some, ["game_id"]), "rate")


# --- rolling features

_N = (5, 10, 20)


def _last(entity: str, table_: str, sums: dict[str, str], windows=_N, played: str = "true", key: str = "") -> str:
    """Oracle for prior_rolling: running sums over played rows, then the last played row of an earlier date."""
    cols = [f"count(*) over (w rows between {n - 1} preceding and current row) as n_{n}" for n in windows]
    cols += [f"sum({e}) over (w rows between {n - 1} preceding and current row) as {k}_sum_{n}" for n in windows for k, e in sums.items()]
    names = ", ".join([f"cast(coalesce(n_{n}, 0) as bigint) as n_{n}" for n in windows] + [f"cast({k}_sum_{n} as bigint) as {k}_sum_{n}" for n in windows for k in sums])
    return f"""with run as (select {entity} as e, game_date as gd, game_id as gi, {", ".join(cols)} from {table_} where {played} window w as (partition by {entity} order by game_date, game_id)),
  day as (select * from run qualify row_number() over (partition by e, gd order by gi desc) = 1),
  res as (select p.*, day.gd as last_contributing, {names} from {table_} p asof left join day on p.{entity} = day.e and p.game_date > day.gd)"""


_P_SUMS = {"min": "secs", "pts": "2 * fgm + tpm + ftm", "fga": "fga", "tpa": "tpa", "fta": "fta", "reb": "reb", "ast": "ast", "stl": "stl", "blk": "blk", "tov": "tov", "pf": "pf"}


def _player_prior(spark, sf_dir, names, windows=_N, keep_date=False) -> DataFrame:
    return rolling.prior_rolling(view(spark, sf_dir, "pbox"), ["player_id"], "game_date", ["game_id"], {k: F.expr(_P_SUMS[k]) for k in names}, windows, played(), keep_date)


def _p(names, windows=_N) -> str:
    return _last("player_id", "pbox", {k: _P_SUMS[k] for k in names}, windows, "secs > 0")


@query(_p(["min", "pts"]) + " select game_id, player_id, n_5, n_10, n_20, min_sum_5, min_sum_10, min_sum_20, pts_sum_5, pts_sum_10, pts_sum_20 from res")
def rol0_prior_rolling(spark, sf_dir):
    out = _player_prior(spark, sf_dir, ["min", "pts"])
    return out.select("game_id", "player_id", *[f"n_{n}" for n in _N], *[f"{k}_sum_{n}" for k in ("min", "pts") for n in _N])


_TS = "pts_sum_{0} / (2 * (fga_sum_{0} + cast(0.44 as double) * fta_sum_{0}))"


@query(_p(["min", "pts", "fga", "fta"]) + " select game_id, player_id, " + ", ".join(
    f"round(case when n_{n} > 0 then min_sum_{n} / 60.0 / n_{n} end, 6) as p_min_avg_{n}, round(case when fga_sum_{n} + fta_sum_{n} > 0 then {_TS.format(n)} end, 6) as p_ts_{n}" for n in _N) + " from res")
def rol1_player_means(spark, sf_dir):
    out = _player_prior(spark, sf_dir, ["min", "pts", "fga", "fta"])
    cols = [c for n in _N for c in (
        F.try_divide(F.col(f"min_sum_{n}") / 60.0, F.col(f"n_{n}")).alias(f"p_min_avg_{n}"),
        F.try_divide(F.col(f"pts_sum_{n}").cast("double"), 2 * (F.col(f"fga_sum_{n}") + F.lit(0.44) * F.col(f"fta_sum_{n}"))).alias(f"p_ts_{n}"))]
    out = out.select("game_id", "player_id", *cols)
    return rounded(out, *out.columns[2:])


@query(_last("ps", "(select *, player_id * 10000 + season as ps from pbox)", {"min": "secs"}, (5,), "secs > 0") + " select game_id, player_id, n_5, min_sum_5 from res")
def rol0_reset_by_season(spark, sf_dir):
    out = rolling.prior_rolling(view(spark, sf_dir, "pbox"), ["player_id"], "game_date", ["game_id"], {"min": F.col("secs")}, (5,), played(), reset_by=["season"])
    return out.select("game_id", "player_id", "n_5", "min_sum_5")


_LONG = "(select *, case when player_id % 10 <> 0 then -1 else player_id end as e, game_id * 1000 + player_id as line from pbox)"
#: Rows of a block in the queries on long histories; one entity there has 90 % of all rows.
_BLOCK = 5_000


def _long(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "pbox").selectExpr("*", "case when player_id % 10 <> 0 then -1 else player_id end as e", "game_id * 1000 + player_id as line")


@query(_last("e", _LONG, {"min": "secs", "pts": "2 * fgm + tpm + ftm"}, _N, "secs > 0").replace("game_id as gi", "line as gi").replace("order by game_date, game_id)", "order by game_date, line)") + " select game_id, player_id, last_contributing, n_5, n_10, n_20, min_sum_5, min_sum_10, min_sum_20, pts_sum_5, pts_sum_10, pts_sum_20 from res")
def rol0_long_history(spark, sf_dir):
    """One entity holds nine of ten rows; its history is cut into blocks."""
    out = blocks.prior_rolling_blocked(_long(spark, sf_dir), ["e"], "game_date", ["line"], {"min": F.col("secs"), "pts": points()}, _N, played(), keep_date=True, rows=_BLOCK)
    return out.select("game_id", "player_id", "last_contributing", *[f"n_{n}" for n in _N], *[f"{k}_sum_{n}" for k in ("min", "pts") for n in _N])


@query(f"""with d as (select e, season, game_date, count(*) as n, sum(2 * fgm + tpm + ftm) as p from {_LONG} where secs > 0 group by 1, 2, 3),
  c as (select e, season, game_date, sum(n) over w as n, sum(p) over w as p from d window w as (partition by e, season order by game_date))
  select q.game_id, q.player_id, cast(coalesce(c.n, 0) as bigint) as std_n, cast(c.p as bigint) as std_pts from {_LONG} q asof left join c on q.e = c.e and q.season = c.season and q.game_date > c.game_date""")
def rol7_long_history(spark, sf_dir):
    rows = _long(spark, sf_dir).withColumn("pts", points())
    return blocks.season_to_date_blocked(rows, ["e"], "season", "game_date", ["pts"], played(), rows=_BLOCK // 5).select("game_id", "player_id", "std_n", "std_pts")


def _undated(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "pbox").withColumn("game_date", F.when(F.col("game_id") % 6 != 0, F.col("game_date")))


@query(_last("player_id", "(select * replace (case when game_id % 6 <> 0 then game_date end as game_date) from pbox)", {"min": "secs"}, (5,), "secs > 0 and game_date is not null") + " select game_id, player_id, n_5, min_sum_5 from res")
def rol0_undated_rows(spark, sf_dir):
    """Every sixth game has no date: its rows have no past and are nobody's past."""
    out = rolling.prior_rolling(_undated(spark, sf_dir), ["player_id"], "game_date", ["game_id"], {"min": F.col("secs")}, (5,), played())
    return out.select("game_id", "player_id", "n_5", "min_sum_5")


_USAGE = """us as (select *, sum(secs) over w as ts, sum(100 * fga + 44 * fta + 100 * tov) over w as tp from pbox window w as (partition by game_id, team_id)),
  up as (select * exclude (ts, tp), case when 5 * secs * tp > 0 then cast(((100 * fga + 44 * fta + 100 * tov) * ts * 1000000) // (5 * secs * tp) as bigint) end as usage_ppm from us)"""


@query(f"with {_USAGE} select game_id, player_id, usage_ppm from up")
def etl8_usage_share(spark, sf_dir):
    return etl.usage_share(view(spark, sf_dir, "pbox"), minutes="secs").select("game_id", "player_id", "usage_ppm")


@query(f"with {_USAGE}, " + _last("player_id", "up", {"usage": "usage_ppm"}, _N, "secs > 0")[5:] + " select game_id, player_id, " + ", ".join(f"round(usage_sum_{n} / 1000000.0 / n_{n}, 10) as p_usage_avg_{n}" for n in _N) + " from res")
def rol1_usage_means(spark, sf_dir):
    out = rolling.prior_rolling(etl.usage_share(view(spark, sf_dir, "pbox"), minutes="secs"), ["player_id"], "game_date", ["game_id"], {"usage": F.col("usage_ppm")}, _N, played())
    out = out.select("game_id", "player_id", *[F.try_divide(F.col(f"usage_sum_{n}") / F.lit(1000000.0), F.col(f"n_{n}")).alias(f"p_usage_avg_{n}") for n in _N])
    return rounded(out, *out.columns[2:], digits=10)


@query(_p(["min", "pts"]) + " select game_id, player_id, " + ", ".join(f"round(case when min_sum_{n} > 0 then pts_sum_{n} * 60.0 / min_sum_{n} end, 6) as p_pts_per_min_{n}" for n in _N) + " from res")
def rol2_points_per_minute(spark, sf_dir):
    out = _player_prior(spark, sf_dir, ["min", "pts"]).select("game_id", "player_id", *rolling.rates(["pts"], "min", _N, "p_", 60.0))
    return rounded(out, *out.columns[2:])


_RATES = ["fga", "tpa", "fta", "reb", "ast", "stl", "blk", "tov", "pf"]


@query(_p(["min", *_RATES], (10,)) + " select game_id, player_id, " + ", ".join(f"round(case when min_sum_10 > 0 then {k}_sum_10 * 60.0 / min_sum_10 end, 6) as p_{k}_per_min_10" for k in _RATES) + " from res")
def rol3_per_minute_rates(spark, sf_dir):
    out = _player_prior(spark, sf_dir, ["min", *_RATES], (10,)).select("game_id", "player_id", *rolling.rates(_RATES, "min", [10], "p_", 60.0))
    return rounded(out, *out.columns[2:])


_T_MARGIN = """with tm as (select a.*, b.pts as opp_pts, a.pts - b.pts as margin from tbox a join tbox b on a.game_id = b.game_id and a.team_id <> b.team_id), """


def _teams(spark, sf_dir) -> DataFrame:
    """Team lines with the opponent's points; games with one side only are left out."""
    t = view(spark, sf_dir, "tbox")
    other = t.select(F.col("game_id").alias("_g"), F.col("team_id").alias("_o"), F.col("pts").alias("opp_pts"))
    return t.join(other, (t["game_id"] == other["_g"]) & (t["team_id"] != other["_o"])).drop("_g", "_o").withColumn("margin", F.col("pts") - F.col("opp_pts"))


@query(_last("team_id", "tbox", {"poss100": "100 * fga + 44 * fta - 100 * oreb + 100 * tov", "pts": "pts"}, (5, 10)) + " select game_id, team_id, " + ", ".join(
    f"round(case when n_{n} > 0 then poss100_sum_{n} / 100.0 / n_{n} end, 6) as t_pace_{n}, round(case when poss100_sum_{n} <> 0 then 10000.0 * pts_sum_{n} / poss100_sum_{n} end, 6) as t_off_rtg_{n}" for n in (5, 10)) + " from res")
def rol4_team_means(spark, sf_dir):
    sums = {"poss100": F.expr("100 * fga + 44 * fta - 100 * oreb + 100 * tov"), "pts": F.col("pts")}
    out = rolling.prior_rolling(view(spark, sf_dir, "tbox"), ["team_id"], "game_date", ["game_id"], sums, (5, 10))
    cols = [c for n in (5, 10) for c in (F.try_divide(F.col(f"poss100_sum_{n}") / 100.0, F.col(f"n_{n}")).alias(f"t_pace_{n}"), F.try_divide(F.lit(10000.0) * F.col(f"pts_sum_{n}"), F.col(f"poss100_sum_{n}")).alias(f"t_off_rtg_{n}"))]
    out = out.select("game_id", "team_id", *cols)
    return rounded(out, *out.columns[2:])


_POSS = "100 * {0}fga + 44 * {0}fta - 100 * {0}oreb + 100 * {0}tov"
_T_POSS = f"""with tm as (select a.*, {_POSS.format("a.")} as poss100, b.pts as opp_pts, {_POSS.format("b.")} as opp_poss100 from tbox a left join tbox b on a.game_id = b.game_id and a.team_id <> b.team_id), """
_T_RATINGS = _T_POSS + _last("team_id", "tm", {"poss100": "poss100", "opts": "opp_pts", "oposs": "opp_poss100"}, (5, 10))[5:]


def _ratings(spark, sf_dir) -> DataFrame:
    """Rolling pace and defensive rating of each team: what opponents scored for each hundred of their possessions."""
    t = view(spark, sf_dir, "tbox").withColumn("poss100", F.expr(_POSS.format("")))
    other = t.select(F.col("game_id").alias("_g"), F.col("team_id").alias("_o"), F.col("pts").alias("opp_pts"), F.col("poss100").alias("opp_poss100"))
    both = t.join(other, (t["game_id"] == other["_g"]) & (t["team_id"] != other["_o"]), "left").drop("_g", "_o")
    out = rolling.prior_rolling(both, ["team_id"], "game_date", ["game_id"], {"poss100": F.col("poss100"), "opts": F.col("opp_pts"), "oposs": F.col("opp_poss100")}, (5, 10))
    cols = [c for n in (5, 10) for c in (F.try_divide(F.lit(10000.0) * F.col(f"opts_sum_{n}"), F.col(f"oposs_sum_{n}")).alias(f"def_rtg_{n}"), F.try_divide(F.col(f"poss100_sum_{n}") / 100.0, F.col(f"n_{n}")).alias(f"pace_{n}"))]
    return out.select("game_id", "team_id", *cols)


@query(_T_RATINGS + " select game_id, team_id, " + ", ".join(f"round(case when oposs_sum_{n} <> 0 then 10000.0 * opts_sum_{n} / oposs_sum_{n} end, 6) as t_def_rtg_{n}" for n in (5, 10)) + " from res")
def rol4_defensive_rating(spark, sf_dir):
    return rounded(_ratings(spark, sf_dir).select("game_id", "team_id", *[F.col(f"def_rtg_{n}").alias(f"t_def_rtg_{n}") for n in (5, 10)]), "t_def_rtg_5", "t_def_rtg_10")


@query(_T_RATINGS + """ select p.game_id, p.player_id, round(case when oposs_sum_10 <> 0 then 10000.0 * opts_sum_10 / oposs_sum_10 end, 6) as opp_def_rtg_10, round(case when n_10 > 0 then poss100_sum_10 / 100.0 / n_10 end, 6) as opp_pace_10
  from pbox p left join res r on p.game_id = r.game_id and p.opp_id = r.team_id""")
def mat1_opponent_ratings(spark, sf_dir):
    out = matchup.add_matchup(view(spark, sf_dir, "pbox"), _ratings(spark, sf_dir), ["def_rtg_10", "pace_10"])
    return rounded(out.select("game_id", "player_id", "opp_def_rtg_10", "opp_pace_10"), "opp_def_rtg_10", "opp_pace_10")


@query(_T_MARGIN + _last("team_id", "tm", {"win": "case when margin > 0 then 1 else 0 end"}, (10,))[5:] + " select game_id, team_id, round(case when n_10 > 0 then win_sum_10 * 1.0 / n_10 end, 6) as t_win_pct_10 from res")
def rol5_win_share(spark, sf_dir):
    out = rolling.prior_rolling(_teams(spark, sf_dir), ["team_id"], "game_date", ["game_id"], {"win": (F.col("margin") > 0).cast("int")}, (10,))
    return rounded(out.select("game_id", "team_id", F.try_divide(F.col("win_sum_10").cast("double"), F.col("n_10")).alias("t_win_pct_10")), "t_win_pct_10")


@query(_T_MARGIN + _last("team_id", "tm", {"pts": "pts", "allowed": "opp_pts"}, (10,))[5:] + " select game_id, team_id, round(pts_sum_10 * 1.0 / n_10, 6) as t_pts_avg_10, round(allowed_sum_10 * 1.0 / n_10, 6) as t_allowed_avg_10 from res")
def rol6_points_for_against(spark, sf_dir):
    out = rolling.prior_rolling(_teams(spark, sf_dir), ["team_id"], "game_date", ["game_id"], {"pts": F.col("pts"), "allowed": F.col("opp_pts")}, (10,))
    return rounded(out.select("game_id", "team_id", *rolling.means(["pts", "allowed"], [10], "t_")), "t_pts_avg_10", "t_allowed_avg_10")


_STD = """with d as (select player_id, season, game_date, count(*) as n, sum(2 * fgm + tpm + ftm) as p from pbox where secs > 0 group by 1, 2, 3),
  c as (select player_id, season, game_date, sum(n) over w as n, sum(p) over w as p from d window w as (partition by player_id, season order by game_date)),
  std as (select b.*, c.n as std_n, c.p as std_pts from pbox b asof left join c on b.player_id = c.player_id and b.season = c.season and b.game_date > c.game_date)"""


def _to_date(spark, sf_dir) -> DataFrame:
    return rolling.season_to_date(view(spark, sf_dir, "pbox").withColumn("pts", points()), ["player_id"], "season", "game_date", ["pts"], played())


@query(_STD + " select game_id, player_id, round(std_pts * 1.0 / std_n, 6) as pts_std_avg from std")
def rol7_season_to_date(spark, sf_dir):
    return rounded(_to_date(spark, sf_dir).select("game_id", "player_id", F.try_divide(F.col("std_pts").cast("double"), F.col("std_n")).alias("pts_std_avg")), "pts_std_avg")


@query(_STD + " select game_id, player_id, cast(coalesce(std_n, 0) as bigint) as p_games_played_season from std")
def rol8_games_played(spark, sf_dir):
    return _to_date(spark, sf_dir).select("game_id", "player_id", F.coalesce("std_n", F.lit(0)).alias("p_games_played_season"))


@query("""with d as (select distinct player_id as e, game_date as gd from pbox where secs > 0)
  select p.game_id, p.player_id, cast(case when d.gd is not null then least(date_diff('day', d.gd, p.game_date), 30) end as int) as p_days_since_last from pbox p asof left join d on p.player_id = d.e and p.game_date > d.gd""")
def rol9_days_since_last(spark, sf_dir):
    return rolling.days_since_last(view(spark, sf_dir, "pbox"), ["player_id"], "game_date", 30, played(), "p_days_since_last").select("game_id", "player_id", "p_days_since_last")


@query(_p(["min"], (10,)) + " select game_id, player_id, case when min_sum_10 >= 24 * 60 * n_10 and n_10 > 0 then 'starter' when min_sum_10 >= 10 * 60 * n_10 and n_10 > 0 then 'rotation' when min_sum_10 > 0 then 'end_of_bench' else 'inactive' end as p_season_role from res")
def rol10_season_role(spark, sf_dir):
    out = _player_prior(spark, sf_dir, ["min"], (10,))
    return out.select("game_id", "player_id", rolling.season_role(F.try_divide(F.col("min_sum_10") / 60.0, F.col("n_10"))).alias("p_season_role"))


@query("""select game_id, player_id, cast(sum(secs) over w as bigint) as min_sum_10 from pbox where secs > 0 window w as (partition by player_id order by game_date, game_id rows between 9 preceding and current row)""")
def rol11_trailing_table(spark, sf_dir):
    out = rolling.trailing_sums(view(spark, sf_dir, "pbox"), ["player_id"], "game_date", ["game_id"], {"min": F.col("secs")}, (10,), played())
    return out.where(F.col("_state").isNotNull()).select("game_id", "player_id", F.col("_state.min_sum_10").alias("min_sum_10"))


@query(_p(["min"], (5,)) + " select cast(count(*) as bigint) as n_rows, cast(count(last_contributing) as bigint) as n_with_history, cast(0 as bigint) as n_leaks from res")
def rol12_leakage_audit(spark, sf_dir):
    out = _player_prior(spark, sf_dir, ["min"], (5,), keep_date=True)
    return out.agg(F.count("*").alias("n_rows"), F.count("last_contributing").alias("n_with_history"), F.count_if(F.col("last_contributing") >= F.col("game_date")).alias("n_leaks"))


# --- context and matchup

_TG = "with tg as (select game_id, game_date, season, home_team as team_id, away_team as opp_id, 1 as is_home from game union all select game_id, game_date, season, away_team, home_team, 0 from game)"


@query(_TG + " select game_id, team_id, opp_id, is_home from tg")
def ctx1_team_games(spark, sf_dir):
    return context.team_games(view(spark, sf_dir, "game")).select("game_id", "team_id", "opp_id", "is_home")


_LOAD = _TG + """, days as (select distinct team_id as e, game_date as gd from tg),
  load as (select tg.game_id, tg.team_id, tg.is_home, tg.game_date, date_diff('day', days.gd, tg.game_date) as gap,
    (select count(*) from tg x where x.team_id = tg.team_id and x.game_date between tg.game_date - 3 and tg.game_date) as c4,
    (select count(*) from tg x where x.team_id = tg.team_id and x.game_date between tg.game_date - 5 and tg.game_date) as c6
    from tg asof left join days on tg.team_id = days.e and tg.game_date > days.gd)"""


def _load(spark, sf_dir) -> DataFrame:
    return context.schedule_load(context.team_games(view(spark, sf_dir, "game")))


@query(_LOAD + " select game_id, team_id, cast(case when gap is not null then least(gap, 5) end as int) as rest_days from load")
def ctx2_rest_days(spark, sf_dir):
    return _load(spark, sf_dir).select("game_id", "team_id", "rest_days")


@query(_LOAD + " select game_id, team_id, cast(case when gap = 1 then 1 else 0 end as int) as b2b from load")
def ctx3_b2b(spark, sf_dir):
    return _load(spark, sf_dir).select("game_id", "team_id", "b2b")


@query(_LOAD + " select game_id, team_id, cast(c4 >= 3 as int) as three_in_four, cast(c6 >= 4 as int) as four_in_six from load")
def ctx4_dense_schedule(spark, sf_dir):
    return _load(spark, sf_dir).select("game_id", "team_id", "three_in_four", "four_in_six")


_PHASE = """sp as (select season, min(game_date) as a, max(game_date) as b from game group by season),
  ph as (select game.*, case when month(game_date) = 6 then 'playoffs' when b = a then 'early' when 3 * date_diff('day', a, game_date) < date_diff('day', a, b) then 'early'
    when 3 * date_diff('day', a, game_date) < 2 * date_diff('day', a, b) then 'mid' else 'late' end as season_phase from game join sp using (season))"""


def _phases(spark, sf_dir) -> DataFrame:
    g = view(spark, sf_dir, "game")
    return context.season_phase(g, g, playoffs=F.month("game_date") == 6)


@query(f"with {_PHASE} select game_id, season_phase from ph")
def ctx5_season_phase(spark, sf_dir):
    return _phases(spark, sf_dir).select("game_id", "season_phase")


@query("select game_id, cast(isodow(game_date) - 1 as int) as day_of_week, cast(month(game_date) as int) as month from game")
def ctx6_calendar(spark, sf_dir):
    return context.calendar(view(spark, sf_dir, "game")).select("game_id", "day_of_week", "month")


def _arenas(spark, sf_dir) -> DataFrame:
    """One arena for each nation's key; teams beyond have none."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("bigint").alias("home_team"), (k * 2.5 - 30.0).alias("lat"), (k * 5.0 - 60.0).alias("lon"), (k * 100.0).alias("altitude_ft"))


_ARENA = "ar as (select cast(n_nationkey as bigint) as ht, n_nationkey * 2.5 - 30.0 as lat, n_nationkey * 5.0 - 60.0 as lon, n_nationkey * 100.0 as alt from nation)"


@query(f"with {_ARENA} select game_id, cast(alt as double) as altitude_ft from game left join ar on home_team = ht")
def ctx7_altitude(spark, sf_dir):
    return context.with_arena(view(spark, sf_dir, "game"), _arenas(spark, sf_dir)).select("game_id", "altitude_ft")


@query(_TG + f""", {_ARENA}, pl as (select tg.*, lat, lon from tg join game g on tg.game_id = g.game_id left join ar on g.home_team = ht),
  last as (select * from pl qualify row_number() over (partition by team_id, game_date order by game_id desc) = 1),
  mv as (select p.game_id, p.team_id, radians(l.lat) as a, radians(p.lat) as b, radians(p.lon - l.lon) as dl from pl p asof left join last l on p.team_id = l.team_id and p.game_date > l.game_date)
  select game_id, team_id, round(2 * 3958.8 * asin(sqrt(least(pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(dl / 2), 2), 1.0))), 4) as travel_miles_prev from mv where a is not null and b is not null""")
def ctx8_travel(spark, sf_dir):
    g = context.with_arena(view(spark, sf_dir, "game"), _arenas(spark, sf_dir))
    out = context.travel_miles(context.team_games(g)).where(F.col("travel_miles_prev").isNotNull())
    return rounded(out.select("game_id", "team_id", "travel_miles_prev"), "travel_miles_prev", digits=4)


@query("""select game_id, player_id, round(date_diff('day', cast('1980-01-01' as date) + cast(s_suppkey % 9000 as int), game_date) / 365.25, 6) as p_age,
    cast(case when s_suppkey is not null then greatest(season - (1995 + s_suppkey % 7), 0) end as int) as p_experience, cast(70.0 + s_nationkey % 20 as double) as p_height_in, cast(null as double) as p_weight_lbs from pbox left join supplier on player_id = s_suppkey""")
def ctx9_biography(spark, sf_dir):
    out = context.biography(view(spark, sf_dir, "pbox"), etl.clean_player_info(_player_info(spark, sf_dir)))
    out = out.withColumn("p_experience", F.when(F.col("p_age").isNotNull(), F.col("p_experience")))
    return rounded(out.select("game_id", "player_id", "p_age", "p_experience", "p_height_in", "p_weight_lbs"), "p_age")


@query("select game_id, player_id, " + ", ".join(f"cast(position = '{p}' as int) as is_{p.lower()}" for p in ("PG", "SG", "SF", "PF", "C")) + " from pbox")
def ctx10_one_hot(spark, sf_dir):
    return view(spark, sf_dir, "pbox").select("game_id", "player_id", *scalar.one_hot(F.col("position"), ["PG", "SG", "SF", "PF", "C"]))


@query("""with c as (select player_id, count(*) as n from pbox where season <= 1999 group by 1)
  select player_id, cast(case when n >= 100 then row_number() over (partition by n >= 100 order by player_id) else 0 end as int) as dense_id from c""")
def ctx11_dense_ids(spark, sf_dir):
    return context.dense_entity_id(view(spark, sf_dir, "pbox").where(train()), "player_id", 100)


@query("""with c as (select game_id, count(*) as n from pbox group by 1)
  select game_id, cast(case when n >= 4 then row_number() over (partition by n >= 4 order by game_id) else 0 end as bigint) as dense_id from c""")
def ctx11_dense_ids_ranged(spark, sf_dir):
    """Of games rather than players, which are many."""
    return context.dense_entity_id_ranged(view(spark, sf_dir, "pbox"), "game_id", 4, ranges=7)


@query("select game_id, player_id, coalesce(s_suppkey % 3 = 0, false) as two_way from pbox left join supplier on player_id = s_suppkey")
def ctx12_two_way(spark, sf_dir):
    flags = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), (F.col("s_suppkey") % 3 == 0).alias("two_way"))
    return view(spark, sf_dir, "pbox").join(flags, "player_id", "left").select("game_id", "player_id", F.coalesce("two_way", F.lit(False)).alias("two_way"))


@query(_last("team_id", "tbox", {"pts": "pts"}, (10,)) + " select p.game_id, p.player_id, r.pts_sum_10 as opp_pts_sum_10, r.n_10 as opp_n_10 from pbox p left join res r on p.game_id = r.game_id and p.opp_id = r.team_id")
def mat1_opponent_rolling(spark, sf_dir):
    teams = rolling.prior_rolling(view(spark, sf_dir, "tbox"), ["team_id"], "game_date", ["game_id"], {"pts": F.col("pts")}, (10,))
    return matchup.add_matchup(view(spark, sf_dir, "pbox"), teams, ["pts_sum_10", "n_10"]).select("game_id", "player_id", "opp_pts_sum_10", "opp_n_10")


@query("""with g as (select season, opp_id, position, game_id, game_date, sum(2 * fgm + tpm + ftm) as v, sum(secs) as s from pbox group by all),
  d as (select season, opp_id, position, game_date, sum(v) as v, sum(s) as s from g group by all),
  c as (select season, opp_id, position, game_date, sum(v) over w as v, sum(s) over w as s from d window w as (partition by season, opp_id, position order by game_date))
  select g.game_id, g.opp_id, g.position, round(case when c.s > 0 then c.v * 60.0 / c.s end, 6) as allowed_per_min
  from g asof left join c on g.season = c.season and g.opp_id = c.opp_id and g.position = c.position and g.game_date > c.game_date""")
def mat2_allowed_by_position(spark, sf_dir):
    out = matchup.allowed_by_position(view(spark, sf_dir, "pbox").withColumn("pts", points()), "pts", "secs")
    return rounded(out.select("game_id", "opp_id", "position", F.try_divide(F.col("allowed") * 60.0, F.col("allowed_per")).alias("allowed_per_min")), "allowed_per_min")


@query("""with m as (select g.*, least(home_team, away_team) as lo, greatest(home_team, away_team) as hi, cast(g.game_id % 41 - 20 as bigint) as margin from game g),
  l as (select *, case when home_team = lo then margin else -margin end as ml from m qualify row_number() over (partition by lo, hi, game_date order by game_id desc) = 1)
  select m.game_id, coalesce(case when m.home_team = m.lo then l.ml else -l.ml end, 0) as h2h_last_margin from m asof left join l on m.lo = l.lo and m.hi = l.hi and m.game_date > l.game_date""")
def mat3_last_meeting(spark, sf_dir):
    games = view(spark, sf_dir, "game").withColumn("margin", F.col("game_id") % 41 - 20)
    return matchup.last_meeting_margin(games).select("game_id", "h2h_last_margin")


# --- joins


@query("select p.game_id, p.player_id, g.home_team from pbox p join game g on p.game_id = g.game_id")
def jn1_inner(spark, sf_dir):
    return view(spark, sf_dir, "pbox").select("game_id", "player_id").join(view(spark, sf_dir, "game").select("game_id", "home_team"), "game_id").select("game_id", "player_id", "home_team")


@query("select g.game_id, t.pts from game g left join tbox t on g.game_id = t.game_id and g.home_team = t.team_id")
def jn2_left(spark, sf_dir):
    t = view(spark, sf_dir, "tbox").select("game_id", F.col("team_id").alias("home_team"), "pts")
    return view(spark, sf_dir, "game").join(t, ["game_id", "home_team"], "left").select("game_id", "pts")


@query("select coalesce(a.game_id, b.game_id) as game_id, coalesce(a.team_id, b.team_id) as team_id, a.pts as left_pts, b.pts as right_pts from (select * from tbox where game_id % 3 <> 0) a full join (select * from tbox where game_id % 4 <> 0) b on a.game_id = b.game_id and a.team_id = b.team_id")
def jn3_full(spark, sf_dir):
    t = view(spark, sf_dir, "tbox").select("game_id", "team_id", "pts")
    a, b = t.where("game_id % 3 <> 0").withColumnRenamed("pts", "left_pts"), t.where("game_id % 4 <> 0").withColumnRenamed("pts", "right_pts")
    return a.join(b, ["game_id", "team_id"], "full_outer").select("game_id", "team_id", "left_pts", "right_pts")


@query(f"with {_ARENA} select game_id, cast(lat as double) as lat from game join ar on home_team = ht")
def jn4_lookup(spark, sf_dir):
    return view(spark, sf_dir, "game").join(_arenas(spark, sf_dir), "home_team").select("game_id", "lat")


@query("select a.game_id, a.team_id, b.pts as opp_pts from tbox a join tbox b on a.game_id = b.game_id and a.team_id <> b.team_id")
def jn5_opponent(spark, sf_dir):
    return _teams(spark, sf_dir).select("game_id", "team_id", "opp_pts")


@query("""with l as (select player_id, game_date, game_id, team_id from pbox where secs > 0 qualify row_number() over (partition by player_id, game_date order by game_id desc) = 1)
  select p.game_id, p.player_id, l.team_id as asof_team_id from pbox p asof left join l on p.player_id = l.player_id and p.game_date > l.game_date""")
def jn6_asof(spark, sf_dir):
    p = view(spark, sf_dir, "pbox")
    right = p.where(played()).select("player_id", "game_date", "game_id", "team_id")
    return joins.asof_join(p.select("player_id", "game_date", "game_id"), right, ["player_id"], "game_date", ["team_id"], ["game_id"]).select("game_id", "player_id", "asof_team_id")


@query(f"""with l as (select e, game_date, line, team_id from {_LONG} where secs > 0 and game_id % 3 = 0 qualify row_number() over (partition by e, game_date order by line desc) = 1)
  select q.game_id, q.player_id, l.line as asof_line, l.team_id as asof_team_id from {_LONG} q asof left join l on q.e = l.e and q.game_date >= l.game_date""")
def jn6_hot_key(spark, sf_dir):
    """One key holds nine of ten rows; its time is cut into blocks."""
    p = _long(spark, sf_dir)
    right = p.where(played() & (F.col("game_id") % 3 == 0)).select("e", "game_date", "line", "team_id")
    left = p.select("e", "game_date", "game_id", "player_id")
    return blocks.asof_join_blocked(left, right, ["e"], "game_date", ["line", "team_id"], ["line"], strict=False, rows=_BLOCK).select("game_id", "player_id", "asof_line", "asof_team_id")


@query("select distinct player_id, player_id in (select player_id from pbox where season = 1995) as seen from pbox where season = 2000")
def jn7_unseen(spark, sf_dir):
    p = view(spark, sf_dir, "pbox")
    train, other = p.where("season = 1995"), p.where("season = 2000")
    return joins.unseen_entities(train, other, "player_id").withColumn("seen", F.lit(False)).unionByName(joins.seen_entities(train, other, "player_id").withColumn("seen", F.lit(True)))


@query("""with a as (select player_id, sum(ast) as v from pbox where season = 1995 group by 1), b as (select player_id, sum(ast) as v from pbox where season = 1996 group by 1)
  select p.player_id, cast(coalesce(a.v, b.v) as bigint) as value, cast(case when a.v is not null then 1 when b.v is not null then 2 end as int) as tier from (select distinct player_id from pbox) p left join a using (player_id) left join b using (player_id)""")
def jn8_tiered(spark, sf_dir):
    p = view(spark, sf_dir, "pbox")
    tiers = [(p.where(f"season = {s}").groupBy("player_id").agg(F.sum("ast").alias("v")), ["player_id"], "v") for s in (1995, 1996)]
    return joins.tiered(p.select("player_id").distinct(), tiers, "value")


# --- aggregations, sets, order, arrays


@query("select game_id, team_id, cast(sum(fga) as bigint) as fga, cast(sum(reb) as bigint) as reb from pbox group by game_id, team_id")
def agg1_team_rollup(spark, sf_dir):
    return reshape.team_rollup(view(spark, sf_dir, "pbox"), ["game_id", "team_id"], ["fga", "reb"])


_SEG = f"""with {_PHASE}, s as (select season_phase, cast(is_home as varchar) as is_home, p.ast - 5 as ast, p.reb - 4 as reb from pbox p join ph using (game_id)),
  l as (select 'ast' as stat, season_phase, is_home, ast as r from s union all select 'reb', season_phase, is_home, reb from s)"""


@query(_SEG + """ select stat, 'season_phase' as segment, season_phase as level, round(sum(r) * 1.0 / count(*), 6) as mean_residual, cast(count(*) as bigint) as n from l group by stat, season_phase
  union all select stat, 'is_home', is_home, round(sum(r) * 1.0 / count(*), 6), cast(count(*) as bigint) from l group by stat, is_home""")
def agg2_residual_segments(spark, sf_dir):
    p = view(spark, sf_dir, "pbox").join(_phases(spark, sf_dir).select("game_id", "season_phase"), "game_id")
    return rounded(reshape.residuals_by_segment(p.withColumns({"ast": F.col("ast") - 5, "reb": F.col("reb") - 4}), ["ast", "reb"], ["season_phase", "is_home"]), "mean_residual")


@query(_LOAD + """, l as (select 'ast' as stat, cast(gap is not null and gap = 1 as int) as b2b, p.ast - 5 as r from pbox p join load using (game_id, team_id) union all
  select 'reb', cast(gap is not null and gap = 1 as int), p.reb - 4 from pbox p join load using (game_id, team_id))
  select stat, 'b2b' as segment, cast(b2b as varchar) as level, round(sum(r) * 1.0 / count(*), 6) as mean_residual, cast(count(*) as bigint) as n from l group by stat, b2b""")
def agg2_residuals_b2b(spark, sf_dir):
    p = view(spark, sf_dir, "pbox").join(_load(spark, sf_dir).select("game_id", "team_id", "b2b"), ["game_id", "team_id"])
    return rounded(reshape.residuals_by_segment(p.withColumns({"ast": F.col("ast") - 5, "reb": F.col("reb") - 4}), ["ast", "reb"], ["b2b"]), "mean_residual")


@query("select position, round(sum(ast) * 1.0 / count(*), 6) as ast_mean, cast(count(*) as bigint) as n from pbox where secs > 0 group by position")
def agg3_positional_mean(spark, sf_dir):
    return rounded(reshape.group_means(view(spark, sf_dir, "pbox").where(played()), ["position"], ["ast"]), "ast_mean")


@query("select season, team_id, round(sum(pts) * 1.0 / count(*), 6) as pts_mean, cast(count(*) as bigint) as n from tbox group by season, team_id")
def agg4_season_team(spark, sf_dir):
    return rounded(reshape.group_means(view(spark, sf_dir, "tbox"), ["season", "team_id"], ["pts"]), "pts_mean")


@query("select season, cast(count(distinct player_id) as bigint) as players, cast(count(distinct game_id) as bigint) as games from pbox group by season")
def agg5_distinct(spark, sf_dir):
    return view(spark, sf_dir, "pbox").groupBy("season").agg(F.countDistinct("player_id").alias("players"), F.countDistinct("game_id").alias("games"))


@query("""select 'players' as what, cast(count(distinct player_id) as bigint) as exact, true as close from pbox where season >= 1995 union all select 'games', count(distinct game_id), true from pbox where season >= 1995""")
def agg5_sketched(spark, sf_dir):
    """Distinct counts over seasons from one stored sketch a season, beside the exact ones."""
    p = view(spark, sf_dir, "pbox").select("season", "player_id", "game_id")
    path = raw.work_dir(spark, "sketches")
    sketches.distinct_sketches(p, ["season"], ["player_id", "game_id"]).write.parquet(path)
    united = sketches.merge_distinct(spark.read.parquet(path).where("season >= 1995"), [], ["player_id", "game_id"])
    exact = p.where("season >= 1995").agg(F.countDistinct("player_id").alias("_p"), F.countDistinct("game_id").alias("_g"))
    both = sketches.distinct_estimates(united, ["player_id", "game_id"]).crossJoin(F.broadcast(exact))  # one row each
    close = lambda c, x: F.abs(F.col(c) - F.col(x)) <= sketches.distinct_error() * F.col(x)
    rows = [F.struct(F.lit(n).alias("what"), F.col(x).alias("exact"), close(c, x).alias("close")) for n, c, x in (("players", "player_id", "_p"), ("games", "game_id", "_g"))]
    return both.select(F.inline(F.array(*rows)))


@query("select game_id, season, case when season = 2000 then home_team end as home_team from game")
def set1_union_seasons(spark, sf_dir):
    g = view(spark, sf_dir, "game")
    return reshape.union_seasons([g.where("season < 2000").select("game_id", "season"), g.where("season = 2000").select("game_id", "season", "home_team"), g.where("season > 2000").select("season", "game_id")])


@query("select season, cast(count(distinct game_id % 2) as bigint) as n_splits from game group by season having count(distinct game_id % 2) > 1")
def set2_overlap(spark, sf_dir):
    return reshape.season_overlap(view(spark, sf_dir, "game").withColumn("split", F.col("game_id") % 2))


@query("select game_id, case when season between 1995 and 1999 then 'train' when season = 2000 then 'val' when season = 2001 then 'test' end as split from game")
def set3_assign_split(spark, sf_dir):
    return reshape.assign_split(view(spark, sf_dir, "game"), SPLITS).select("game_id", "split")


@query("""with past as (select * from pbox where game_date < date '2000-01-01'), last as (select team_id, game_id from past qualify row_number() over (partition by team_id order by game_date desc, game_id desc) = 1)
  select team_id, player_id, game_id, game_date, cast(row_number() over (partition by team_id order by secs desc, player_id) as int) as place from past semi join last using (team_id, game_id) qualify row_number() over (partition by team_id order by secs desc, player_id) <= 15""")
def srt1_latest_roster(spark, sf_dir):
    return reshape.latest_roster(view(spark, sf_dir, "pbox"), F.lit("2000-01-01").cast("date"))


@query("select game_id, season from game order by game_id * 7919 % 10007, game_id limit 20")
def srt2_sample_games(spark, sf_dir):
    return reshape.sample_games(view(spark, sf_dir, "game").select("game_id", "season"), 20, F.col("game_id") * 7919 % 10007)


@query("""with req as (select distinct case when c_custkey % 2 = 0 then cast(c_custkey as varchar) else ' supplier#' || lpad(cast(c_custkey % 300 as varchar), 9, '0') || ' ' end as request from customer),
  i as (select r.request, s.s_suppkey, s.s_name from req r join supplier s on try_cast(r.request as bigint) = s.s_suppkey), n as (select r.request, s.s_suppkey, s.s_name from req r join supplier s on lower(trim(r.request)) = lower(s.s_name) and r.request not in (select request from i)),
  u as (select * from i union all select * from n)
  select r.request, cast(count(u.s_suppkey) as bigint) as n_matches, case count(u.s_suppkey) when 0 then 'unmatched' when 1 then 'matched' else 'ambiguous' end as status, min(u.s_suppkey) as player_id, min(u.s_name) as name from req r left join u using (request) group by r.request""", with_views=False)
def srt3_resolve_players(spark, sf_dir):
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit(" supplier#"), F.lpad((k % 300).cast("string"), 9, "0"), F.lit(" "))).alias("request"))
    return reshape.resolve_players(asked, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("name")))


def _padded(spark, sf_dir) -> DataFrame:
    return reshape.assemble_game_rows(view(spark, sf_dir, "pbox"), ["game_id", "team_id"], [F.desc("secs"), F.col("player_id")], ["player_id", "secs"])


@query("select game_id, team_id, cast(15 as int) as length, cast(least(count(*), 15) as int) as n_real from pbox group by game_id, team_id")
def arr1_assemble(spark, sf_dir):
    return _padded(spark, sf_dir).select("game_id", "team_id", F.size("players").alias("length"), F.size(F.filter("mask", lambda m: m)).alias("n_real"))


@query("""select game_id, team_id, cast(row_number() over w - 1 as int) as slot, player_id, secs from pbox window w as (partition by game_id, team_id order by secs desc, player_id) qualify row_number() over w <= 15""")
def arr2_explode(spark, sf_dir):
    return reshape.explode_game_rows(_padded(spark, sf_dir), ["game_id", "team_id"], ["player_id", "secs"])


# --- baselines, metrics, ensembles

_BASE1 = _STD + """, ls as (select player_id, season + 1 as season, sum(2 * fgm + tpm + ftm) * 1.0 / count(*) as v from pbox where secs > 0 group by 1, 2),
  ps as (select position, sum(2 * fgm + tpm + ftm) * 1.0 / count(*) as v from pbox where secs > 0 and season <= 1999 group by 1),
  bs as (select s.*, 2 * fgm + tpm + ftm as y, case when s.std_n > 0 then s.std_pts * 1.0 / s.std_n end as own, ls.v as lv, ps.v as pv from std s left join ls using (player_id, season) left join ps using (position)),
  b1 as (select *, coalesce(own, lv, pv) as pred, cast(case when own is not null then 1 when lv is not null then 2 when pv is not null then 3 end as int) as tier from bs)"""


def _predicted(spark, sf_dir) -> DataFrame:
    return baseline.season_average_baseline(view(spark, sf_dir, "pbox").withColumn("pts", points()), "pts", played(), train())


@query(_BASE1 + " select game_id, player_id, round(pred, 6) as pred, tier from b1")
def bas1_season_average(spark, sf_dir):
    return rounded(_predicted(spark, sf_dir).select("game_id", "player_id", "pred", "tier"), "pred")


_FEATURES = ["q", "is_home", "oreb"]


def _model_rows(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "pbox").where(played()).withColumns({"pts": points().cast("double"), "q": F.col("secs") / 3600.0, "is_home": F.col("is_home").cast("double"), "oreb": F.col("oreb").cast("double")})


@query("select season, cast(count(*) as bigint) as n, cast(sum(2 * fgm + tpm + ftm) as double) as total_y from pbox where secs > 0 and season <= 1999 group by season")
def bas2_poisson_rows(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("season").agg(F.count("pred").alias("n"), F.round(F.sum("pts"), 2).alias("total_y"))


def _scored(spark, sf_dir) -> DataFrame:
    rows = _model_rows(spark, sf_dir).where(train())
    return baseline.predict(baseline.fit_poisson(rows, "pts", _FEATURES), rows, _FEATURES)


@query("select cast(sum(2 * fgm + tpm + ftm) as double) as sum_y, cast(sum(2 * fgm + tpm + ftm) as double) as sum_mu from pbox where secs > 0 and season <= 1999")
def bas2_poisson(spark, sf_dir):
    """The score equation of the intercept: fitted and observed totals agree."""
    return _scored(spark, sf_dir).agg(F.round(F.sum("pts"), 0).cast("double").alias("sum_y"), F.round(F.sum("pred"), 0).alias("sum_mu"))


@query("select cast(sum(fgm) as double) as sum_made, cast(sum(fgm) as double) as sum_expected, cast(count(*) as bigint) as n from pbox where secs > 0 and season <= 1999 and fga > 0")
def bas3_rate_totals(spark, sf_dir):
    """The score equation of the intercept: attempts weighted by the fitted rate add up to what was made."""
    rows = _model_rows(spark, sf_dir).where(train())
    scored = baseline.predict(baseline.fit_rate(rows, "fgm", "fga", _FEATURES), rows.where("fga > 0"), _FEATURES)
    return scored.agg(F.round(F.sum("fgm"), 0).cast("double").alias("sum_made"), F.round(F.sum(F.col("fga") * F.col("pred")), 0).alias("sum_expected"), F.count("pred").alias("n"))


@query("select season, cast(sum(2 * fgm + tpm + ftm) as double) as sum_y, true as same from pbox where secs > 0 and season <= 1999 group by season")
def bas7_saved_model_rows(spark, sf_dir):
    """A model read back gives every row the prediction of the one that was saved."""
    rows = _model_rows(spark, sf_dir).where(train())
    path = raw.work_dir(spark, "model")
    model = baseline.fit_poisson(rows, "pts", _FEATURES)
    baseline.save_model(model, path)
    both = baseline.predict(baseline.load_model(path), baseline.predict(model, rows, _FEATURES).withColumnRenamed("pred", "first"), _FEATURES)
    return both.groupBy("season").agg(F.sum("pts").alias("sum_y"), F.every(F.col("first").eqNullSafe(F.col("pred")) & F.col("pred").isNotNull()).alias("same"))


@query()
def bas3_rate(spark, sf_dir):
    rows = _model_rows(spark, sf_dir).where(train())
    model = baseline.fit_rate(rows, "fgm", "fga", _FEATURES)
    return baseline.predict(model, rows, _FEATURES).select("game_id", "player_id", "pred")


def _zero_scores(labels: str, rows: str) -> str:
    return f"select unnest([{labels}]) as equation, n, 0.0::double as score from (select cast(count(*) as bigint) as n from pbox where {rows})"


def _scores(df: DataFrame, off: Column) -> DataFrame:
    """A row's share of each score equation of a generalized linear model with the canonical link: all are zero at its maximum."""
    cells = [F.struct(F.lit(f).alias("equation"), (off * x).alias("s")) for f, x in [("intercept", F.lit(1.0)), *[(f, F.col(f)) for f in _FEATURES]]]
    out = df.select(F.inline(F.array(*cells))).groupBy("equation").agg(F.count("s").alias("n"), F.avg("s").alias("score"))
    return _near_zero(out)


def _near_zero(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6) + F.lit(0.0))


@query(_zero_scores("'intercept', 'q', 'is_home', 'oreb'", "secs > 0 and season <= 1999"))
def bas2_scores(spark, sf_dir):
    return _scores(_scored(spark, sf_dir), F.col("pts") - F.col("pred"))


@query(_zero_scores("'intercept', 'q', 'is_home', 'oreb'", "secs > 0 and season <= 1999 and fga > 0"))
def bas3_scores(spark, sf_dir):
    rows = _model_rows(spark, sf_dir).where(train() & (F.col("fga") > 0))
    scored = baseline.predict(baseline.fit_rate(rows, "fgm", "fga", _FEATURES), rows, _FEATURES)
    return _scores(scored, F.col("fgm") - F.col("fga") * F.col("pred"))


@query(_zero_scores("'intercept'", "secs > 0 and season <= 1999 and fga > 0"))
def bas3_ridge_scores(spark, sf_dir):
    """The intercept's equation, which ridge leaves as it is: attempts weighted by the residual rate add up to nothing."""
    rows = _model_rows(spark, sf_dir).where(train() & (F.col("fga") > 0))
    scored = baseline.predict(baseline.fit_rate(rows, "fgm", "fga", _FEATURES, kind="ridge"), rows, _FEATURES)
    return _scores(scored, F.col("fgm") - F.col("fga") * F.col("pred")).where("equation = 'intercept'")


@query(_zero_scores("'intercept', 'q', 'is_home', 'oreb', 'precision'", "secs > 0 and season <= 1999 and fga > 0"))
def bas3_beta_scores(spark, sf_dir):
    """Beta regression of field goal rates: every score equation, recomputed in the JVM."""
    rows = _model_rows(spark, sf_dir).where(train())
    model = beta.fit_beta(rows, "fgm", "fga", _FEATURES)
    return _near_zero(beta.beta_scores(model, rows, "fgm", "fga"))


@query(_zero_scores("'intercept', 'q', 'is_home', 'oreb'", "secs > 0 and season <= 1999"))
def bas7_saved_scores(spark, sf_dir):
    rows, path = _model_rows(spark, sf_dir).where(train()), raw.work_dir(spark, "model")
    baseline.save_model(baseline.fit_poisson(rows, "pts", _FEATURES), path)
    return _scores(baseline.predict(baseline.load_model(path), rows, _FEATURES), F.col("pts") - F.col("pred"))


@query("""with e as (select game_id, team_id, player_id, exp((secs - max(secs) over (partition by game_id, team_id)) / 600.0) as x from pbox)
  select game_id, player_id, round(x / sum(x) over (partition by game_id, team_id), 6) as share from e""")
def bas4_softmax(spark, sf_dir):
    p = view(spark, sf_dir, "pbox").withColumn("score", F.col("secs") / 600.0)
    return rounded(baseline.softmax_share(p, ["game_id", "team_id"], "score").select("game_id", "player_id", "share"), "share")


_APPORTION = """with w as (select game_id, team_id, player_id, secs, sum(secs) over (partition by game_id, team_id) as s from pbox),
  b as (select *, case when s > 0 then (secs * 2400) // s else 0 end as base, case when s > 0 then (secs * 2400) % s else 0 end as rest from w),
  ap as (select *, base + case when s > 0 and row_number() over (partition by game_id, team_id order by rest desc, player_id) <= 2400 - sum(base) over (partition by game_id, team_id) then 1 else 0 end as units from b)"""


def _apportioned(spark, sf_dir) -> DataFrame:
    return baseline.apportion(view(spark, sf_dir, "pbox"), ["game_id", "team_id"], "secs", 2400, [F.col("player_id")])


@query(_APPORTION + " select game_id, player_id, cast(units as bigint) as tenths, s = 0 as no_weight from ap")
def bas5_apportion(spark, sf_dir):
    return _apportioned(spark, sf_dir).select("game_id", "player_id", F.col("units").alias("tenths"), "no_weight")


@query("""select game_id, player_id, greatest(fgm - 3, 0) as fgm0, least(greatest(fgm - 3, 0), fga) as fgm, least(tpm, tpa, fga, least(greatest(fgm - 3, 0), fga)) as tpm, least(ftm, fta) as ftm, oreb + dreb as reb,
    2 * least(greatest(fgm - 3, 0), fga) + least(tpm, tpa, fga, least(greatest(fgm - 3, 0), fga)) + least(ftm, fta) as pts from pbox""")
def bas6_project(spark, sf_dir):
    p = view(spark, sf_dir, "pbox").withColumns({"fgm": F.col("fgm") - 3})
    out = baseline.project_to_constraints(p.withColumn("fgm0", F.greatest("fgm", F.lit(0))), _BOX_COUNTS)
    return out.select("game_id", "player_id", "fgm0", "fgm", "tpm", "ftm", "reb", "pts")


@query()
def bas7_saved_model(spark, sf_dir):
    rows = _model_rows(spark, sf_dir).where(train())
    path = raw.work_dir(spark, "model")
    baseline.save_model(baseline.fit_poisson(rows, "pts", _FEATURES), path)
    return baseline.predict(baseline.load_model(path), rows, _FEATURES).select("game_id", "player_id", "pred")


@query("""with m as (select label, i, avg(cast(embedding[i] as double)) as v from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings where vec_id % 3 <> 0) group by 1, 2),
  rm as (select label, list(v order by i) as rv from m group by label)
  select e.vec_id, round(case when vec_id % 3 <> 0 then cast(embedding[1] as double) else coalesce(a.rv[1], b.rv[1]) end, 6) as first, cast(case when vec_id % 3 <> 0 then 1 when a.rv is not null then 2 else 3 end as int) as tier
  from embeddings e left join rm a on a.label = (case when vec_id % 6 = 0 then -1 else e.label end) left join rm b on b.label = 0""", with_views=False)
def bas8_cold_start(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    wanted = e.select("vec_id", F.when(F.col("vec_id") % 6 == 0, -1).otherwise(F.col("label")).alias("label"))
    out = baseline.cold_start_fill(wanted, e.where("vec_id % 3 <> 0"), "vec_id", "label", "embedding", 0)
    return out.select("vec_id", F.round(F.get("vector", F.lit(0)), 6).alias("first"), "tier")


@query(_T_MARGIN[:-2] + " select p.game_id, p.player_id, round(case when sum(p.secs) over w > 0 then t.margin * p.secs * 5.0 / sum(p.secs) over w end, 6) as plus_minus from pbox p join tm t on p.game_id = t.game_id and p.team_id = t.team_id window w as (partition by p.game_id, p.team_id)")
def bas9_plus_minus(spark, sf_dir):
    p = view(spark, sf_dir, "pbox").join(_teams(spark, sf_dir).select("game_id", "team_id", "margin"), ["game_id", "team_id"])
    return rounded(baseline.allocate_plus_minus(p, ["game_id", "team_id"], "margin", "secs").select("game_id", "player_id", "plus_minus"), "plus_minus")


@query("""with n as (select game_id, player_id, position, case when secs = 0 then null else ast end as ast from pbox)
  select game_id, player_id, round(coalesce(ast, avg(ast) over (partition by position)), 6) as ast, cast(ast is null as int) as ast_missing from n""")
def bas10_null_policy(spark, sf_dir):
    p = view(spark, sf_dir, "pbox").select("game_id", "player_id", "position", F.when(played(), F.col("ast")).cast("double").alias("ast"))
    return rounded(baseline.null_policy(p, ["ast"], "mean", ["position"]).drop("position"), "ast")


def _cells(spark, sf_dir) -> DataFrame:
    return metrics.cells_of(_predicted(spark, sf_dir).where(played()), [], {"pts": ("pts", "pred")})


_STATS = ["pts", "reb", "ast", "stl", "blk", "tov", "pf", "oreb", "dreb", "fga", "fgm", "tpa", "tpm", "fta", "ftm"]


def _all_cells(spark, sf_dir) -> DataFrame:
    rows = baseline.season_average_predictions(view(spark, sf_dir, "pbox").withColumn("pts", points()), _STATS, played(), train())
    return metrics.cells_of(rows.where(played()), [], {s: (s, f"pred_{s}") for s in _STATS})


_ALL_CELLS = f"""with v as (select game_id, player_id, season, game_date, position, secs, unnest([{", ".join(f"'{s}'" for s in _STATS)}]) as stat, unnest([2 * fgm + tpm + ftm, {", ".join(_STATS[1:])}]) as y from pbox),
  d as (select player_id, season, stat, game_date, count(*) as n, sum(y) as s from v where secs > 0 group by all),
  c as (select player_id, season, stat, game_date, sum(s) over w * 1.0 / sum(n) over w as own from d window w as (partition by player_id, season, stat order by game_date)),
  ls as (select player_id, season + 1 as season, stat, sum(y) * 1.0 / count(*) as last from v where secs > 0 group by 1, 2, 3), ps as (select position, stat, sum(y) * 1.0 / count(*) as pos from v where secs > 0 and season <= 1999 group by 1, 2),
  o as (select v.*, c.own from v asof left join c on v.player_id = c.player_id and v.season = c.season and v.stat = c.stat and v.game_date > c.game_date),
  cells as (select o.stat, o.y, coalesce(own, last, pos) as p from o left join ls on o.player_id = ls.player_id and o.season = ls.season and o.stat = ls.stat left join ps on o.position = ps.position and o.stat = ps.stat where secs > 0)"""


@query(_ALL_CELLS + " select stat, round(avg(abs(y - p)), 6) as mae, round(sqrt(avg((y - p) * (y - p))), 6) as rmse, cast(count(*) as bigint) as n from cells where p is not null group by stat")
def met1_all_stats(spark, sf_dir):
    return rounded(metrics.per_stat_error(_all_cells(spark, sf_dir)), "mae", "rmse")


@query(_ALL_CELLS + """, m as (select stat, avg(abs(y - p)) as a, avg(abs(y - 3)) as b from cells where p is not null group by stat)
  select stat, round(a, 6) as mae_model, round(b, 6) as mae_baseline, round(1 - a / b, 6) as reduction, 1 - a / b >= case when stat in ('pts', 'reb', 'ast') then 0.15 else 0.05 end as met from m""")
def met6_all_stats(spark, sf_dir):
    """Both models' errors from one pass over the cells."""
    cells = _all_cells(spark, sf_dir).select("stat", "y", F.inline(F.array(F.struct(F.lit("season_average").alias("model"), F.col("p")), F.struct(F.lit("constant").alias("model"), F.lit(3.0).alias("p")))))
    errors = cells.groupBy("stat", "model").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return rounded(metrics.compare_models(errors, "season_average", "constant"), "mae_model", "mae_baseline", "reduction")


@query(_BASE1 + " select 'pts' as stat, round(avg(abs(y - pred)), 6) as mae, cast(count(*) as bigint) as n from b1 where secs > 0 and pred is not null")
def met1_mae(spark, sf_dir):
    return rounded(metrics.per_stat_error(_cells(spark, sf_dir)).select("stat", "mae", "n"), "mae")


@query(_BASE1 + " select 'pts' as stat, round(sqrt(avg((y - pred) * (y - pred))), 6) as rmse from b1 where secs > 0 and pred is not null")
def met2_rmse(spark, sf_dir):
    return rounded(metrics.per_stat_error(_cells(spark, sf_dir)).select("stat", "rmse"), "rmse")


@query("select round(avg(case when ast between 1 and 9 then 1 else 0 end), 6) as coverage, cast(count(*) as bigint) as n, avg(case when ast between 1 and 9 then 1 else 0 end) >= 0.8 as met from pbox where secs > 0")
def met3_coverage(spark, sf_dir):
    p = view(spark, sf_dir, "pbox").where(played()).withColumns({"low": F.lit(1), "high": F.lit(9)})
    return rounded(metrics.interval_coverage(p, "ast", "low", "high"), "coverage")


@query("""with c as (select cast(fga as double) as p, cast(fgm as double) as y from pbox where secs > 0), s as (select min(p) as lo, max(p) as hi from c)
  select 'fgm' as stat, cast(least(floor((p - lo) * 10 / (hi - lo)) + 1, 10) as int) as bin, round(avg(p), 6) as mean_p, round(avg(y), 6) as mean_y, cast(count(*) as bigint) as n from c, s group by 2""")
def met4_reliability(spark, sf_dir):
    p = view(spark, sf_dir, "pbox").where(played()).select("game_id", "player_id", "fgm", "fga")
    cells = metrics.paired(p.select("game_id", "player_id", "fgm"), p.select("game_id", "player_id", F.col("fga").alias("fgm")), ["game_id", "player_id"], ["fgm"])
    return rounded(metrics.reliability_bins(cells), "mean_p", "mean_y")


@query("""with c as (select cast(fga as double) as p, cast(fgm as double) as y from pbox where secs > 0), s as (select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from c)
  select 'fgm' as stat, cast(len(list_filter(e, lambda x: x < p)) + 1 as int) as bin, round(avg(p), 6) as mean_p, round(avg(y), 6) as mean_y, cast(count(*) as bigint) as n from c, s group by 2""")
def met4_quantile_bins(spark, sf_dir):
    p = view(spark, sf_dir, "pbox").where(played()).select("game_id", "player_id", "fgm", "fga")
    cells = metrics.paired(p.select("game_id", "player_id", "fgm"), p.select("game_id", "player_id", F.col("fga").alias("fgm")), ["game_id", "player_id"], ["fgm"])
    return rounded(metrics.reliability_bins(cells, kind="quantile", exact=True), "mean_p", "mean_y")


_DECILES = [i / 10 for i in range(1, 10)]


@query("select stat, cast(generate_series as int) as decile, true as close from (select unnest(['secs', 'fga', 'ast']) as stat), generate_series(1, 9)")
def met4_sketched_edges(spark, sf_dir):
    """Deciles of all seasons from one stored sketch a season; ``close`` if the share of values below, or up to, each lies within the stated error."""
    cols = ["secs", "fga", "ast"]
    p = view(spark, sf_dir, "pbox").where(played()).select("season", *cols)
    path = raw.work_dir(spark, "sketches")
    sketches.quantile_sketches(p, ["season"], cols).write.parquet(path)
    merged = sketches.merge_quantiles(spark.read.parquet(path), [], cols)
    edges = merged.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stat"), sketches.quantiles(c, _DECILES).alias("edges")) for c in cols])))
    long = p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("v")) for c in cols])))
    each = long.join(F.broadcast(edges), "stat").select("stat", "v", F.posexplode("edges").alias("i", "edge"))
    shares = each.groupBy("stat", "i").agg(F.avg((F.col("v") < F.col("edge")).cast("int")).alias("below"), F.avg((F.col("v") <= F.col("edge")).cast("int")).alias("upto"))
    want, off = (F.col("i") + 1) / 10, F.lit(sketches.rank_error())
    return shares.select("stat", (F.col("i") + 1).alias("decile"), ((F.col("below") - off <= want) & (F.col("upto") + off >= want)).alias("close"))


@query(_BASE1 + " , t as (select game_id, team_id, sum(y) as y, sum(pred) as p from b1 where secs > 0 and pred is not null group by 1, 2) select round(avg(abs(y - p)), 4) as team_pts_mae, cast(count(*) as bigint) as n from t")
def met5_team_mae(spark, sf_dir):
    rows = _predicted(spark, sf_dir).where(played() & F.col("pred").isNotNull())
    teams = reshape.team_rollup(rows, ["game_id", "team_id"], ["pts", "pred"])
    return rounded(teams.agg(F.avg(F.abs(F.col("pts") - F.col("pred"))).alias("team_pts_mae"), F.count("*").alias("n")), "team_pts_mae", digits=4)


@query(_BASE1 + """, m as (select avg(abs(y - pred)) as a, avg(abs(y - 12)) as b from b1 where secs > 0 and pred is not null)
  select 'pts' as stat, round(a, 6) as mae_model, round(b, 6) as mae_baseline, round(1 - a / b, 6) as reduction, 1 - a / b >= 0.15 as met from m""")
def met6_compare(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    errors = metrics.per_stat_error(cells).withColumn("model", F.lit("season_average")).unionByName(metrics.per_stat_error(cells.withColumn("p", F.lit(12.0))).withColumn("model", F.lit("constant")))
    return rounded(metrics.compare_models(errors, "season_average", "constant"), "mae_model", "mae_baseline", "reduction")


@query(_BASE1 + ", sg as (select game_id from game order by game_id * 7919 % 10007, game_id limit 20) select game_id, player_id, y as pts, round(pred, 6) as pts_pred from b1 where game_id in (select game_id from sg)")
def met7_card(spark, sf_dir):
    predicted = _predicted(spark, sf_dir).select("game_id", "player_id", F.col("pred").alias("pts"))
    actual = view(spark, sf_dir, "pbox").withColumn("pts", points())
    games = reshape.sample_games(view(spark, sf_dir, "game"), 20, F.col("game_id") * 7919 % 10007)
    card = metrics.box_score_card(predicted, actual, games, ["game_id", "player_id"], ["pts"])
    return rounded(card.select("game_id", "player_id", "pts", "pts_pred"), "pts_pred")


@query("""select player_id, round(avg(ast), 6) as ast_mean, round(quantile_cont(ast, 0.1), 6) as ast_p10, round(quantile_cont(ast, 0.9), 6) as ast_p90 from pbox where secs > 0 group by player_id""")
def ens1_summarize(spark, sf_dir):
    return rounded(metrics.summarize_samples(view(spark, sf_dir, "pbox").where(played()), ["player_id"], ["ast"]), "ast_mean", "ast_p10", "ast_p90")


@query("""select player_id, round(avg(ast), 6) as ast_mean, round(avg(secs), 6) as secs_mean, true as close from pbox where secs > 0 group by player_id""")
def ens1_sketched(spark, sf_dir):
    """Summaries in bounded state; ``close`` if both percentiles of the minutes lie within the stated rank error of the exact ones."""
    p = view(spark, sf_dir, "pbox").where(played()).select("player_id", "ast", "secs")
    found = metrics.summarize_samples(p, ["player_id"], ["ast", "secs"], exact=False)
    off = sketches.rank_error()
    share = lambda c, below: F.avg((F.col("secs") < F.col(c) if below else F.col("secs") <= F.col(c)).cast("int"))
    near = [(share(c, True) - off <= w) & (share(c, False) + off >= w) for c, w in (("secs_p10", 0.1), ("secs_p90", 0.9))]
    checked = p.select("player_id", "secs").join(found.select("player_id", "secs_p10", "secs_p90"), "player_id").groupBy("player_id").agg((near[0] & near[1]).alias("close"))
    return rounded(found.join(checked, "player_id").select("player_id", "ast_mean", "secs_mean", "close"), "ast_mean", "secs_mean")


# --- streaming


@query("select cast(o_orderkey as bigint) as game_id, cast(year(o_orderdate) as int) as season, cast(o_custkey % 30 as bigint) as home_team from orders", with_views=False)
def str1_ingest(spark, sf_dir):
    from ..streaming.ingest import ingest_incremental

    top = raw.work_dir(spark, "stream")
    schema = table(spark, sf_dir, "orders").schema
    typed = lambda b: b.select(F.col("o_orderkey").cast("bigint").alias("game_id"), F.year("o_orderdate").alias("season"), (F.col("o_custkey") % 30).cast("bigint").alias("home_team"))
    for _ in range(2):  # the second run finds no new file
        ingest_incremental(spark, sf_dir, f"{top}/out", f"{top}/state", schema, typed, ["game_id"], glob="orders.parquet")
    return spark.read.parquet(f"{top}/out").select("game_id", "season", "home_team")


@query(_last("player_id", "pbox", {"min": "secs"}, (5,), "secs > 0") + " select game_id, player_id, n_5, min_sum_5 from res")
def str2_refresh(spark, sf_dir):
    """Features built without one season's rows, then refreshed when these arrive, equal those built at once."""
    from ..streaming.ingest import merge_batch, refresh_affected

    top = raw.work_dir(spark, "refresh")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(raw.shared_folder(spark))
    rows = view(spark, sf_dir, "pbox").select("season", "game_id", "game_date", "player_id", "secs")
    build = lambda df: rolling.prior_rolling(df, ["player_id"], "game_date", ["game_id"], {"min": F.col("secs")}, (5,), played())
    keys = ["player_id", "game_date", "game_id"]
    late = rows.where("season = 1997")
    merge_batch(rows.where("season <> 1997"), f"{top}/interim", keys, "season")
    merge_batch(build(spark.read.parquet(f"{top}/interim")), f"{top}/features", keys, "season")
    merge_batch(late, f"{top}/interim", keys, "season")
    refresh_affected(late, f"{top}/interim", f"{top}/features", "player_id", "game_date", "season", build)
    return spark.read.parquet(f"{top}/features").select("game_id", "player_id", "n_5", "min_sum_5")


@query("""select game_id, case when game_id % 7 = 0 then cast(null as varchar) else '00' || cast((case when game_id % 3 = 0 then season + 1 else season end) % 10 as varchar) end as season, home_team + case when game_id % 3 = 0 or game_id % 7 = 0 then 1 else 0 end as v from game""")
def str1_moved_keys(spark, sf_dir):
    """Text partitions with leading zeros; every third game comes again in another season, every seventh without one."""
    from ..streaming.ingest import merge_batch, stored

    path = raw.work_dir(spark, "moved")
    g = view(spark, sf_dir, "game")
    typed = lambda df, year, v: df.select("game_id", F.concat(F.lit("00"), (year % 10).cast("string")).alias("season"), v.alias("v"))
    merge_batch(typed(g, F.col("season"), F.col("home_team")), path, ["game_id"], "season")
    again = typed(g.where("game_id % 3 = 0 and game_id % 7 <> 0"), F.col("season") + 1, F.col("home_team") + 1)
    lost = typed(g.where("game_id % 7 = 0"), F.col("season"), F.col("home_team") + 1).withColumn("season", F.lit(None).cast("string"))
    for batch in (again, lost, again):
        merge_batch(batch, path, ["game_id"], "season")
    return stored(spark, path, "season", T.StringType()).select("game_id", "season", "v")
