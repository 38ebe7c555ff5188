"""Properties of the operators: no leakage, exact sums, order independence."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from boxlake.operators import baseline, context, joins, matchup, reshape, rolling

GAMES = "entity long, game_id long, game_date date, secs long"


def history(seed: int, n: int = 300) -> list[tuple]:
    rng, start = random.Random(seed), datetime.date(2020, 1, 1)
    return [(rng.randrange(6), i, start + datetime.timedelta(rng.randrange(60)), rng.choice([0, 600, 1200, 1801])) for i in range(n)]


def rolled(df, n=3):
    return rolling.prior_rolling(df, ["entity"], "game_date", ["game_id"], {"s": F.col("secs")}, (n,), F.col("secs") > 0, keep_date=True)


def brute(rows, n=3):
    out = {}
    for e, g, d, _ in rows:
        past = sorted((x[2], x[1], x[3]) for x in rows if x[0] == e and x[2] < d and x[3] > 0)[-n:]
        out[g] = (len(past), sum(x[2] for x in past) if past else None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_equals_brute_force_and_row_order_does_not_matter(spark, seed):
    rows = history(seed)
    want = brute(rows)
    for part, shuffled in ((1, rows), (7, random.Random(9).sample(rows, len(rows)))):
        got = rolled(spark.createDataFrame(shuffled, GAMES).repartition(part)).collect()
        assert {r.game_id: (r.n_3, r.s_sum_3) for r in got} == want


def test_later_games_change_no_earlier_row(spark):
    rows = history(3)
    more = [(e, g + 1000, datetime.date(2021, 1, 1), 999) for e, g, _, _ in rows[:50]]
    before = {r.game_id: r.s_sum_3 for r in rolled(spark.createDataFrame(rows, GAMES)).collect()}
    after = {r.game_id: r.s_sum_3 for r in rolled(spark.createDataFrame(rows + more, GAMES)).collect()}
    assert all(after[g] == s for g, s in before.items())


def test_leakage_audit(spark):
    out = rolled(spark.createDataFrame(history(4), GAMES))
    rolling.assert_no_future(out, "game_date")
    with pytest.raises(AssertionError):
        rolling.assert_no_future(out.withColumn("last_contributing", F.col("game_date")), "game_date")


def test_cold_start_is_null(spark):
    row = rolled(spark.createDataFrame([(1, 1, datetime.date(2020, 1, 1), 60)], GAMES)).first()
    assert (row.n_3, row.s_sum_3, row.last_contributing) == (0, None, None)


def test_empty_history(spark):
    assert rolled(spark.createDataFrame([], GAMES)).count() == 0


@pytest.mark.parametrize("units", [1, 7, 2400])
def test_apportion_sums_exactly(spark, units):
    rng = random.Random(units)
    rows = [(g, p, rng.randrange(5)) for g in range(40) for p in range(rng.randint(1, 12))] + [(99, p, 0) for p in range(3)] + [(98, 0, None), (98, 1, 2)]
    out = baseline.apportion(spark.createDataFrame(rows, "g long, p long, w long"), ["g"], "w", units, [F.col("p")])
    for r in out.groupBy("g").agg(F.sum("units").alias("s"), F.max("no_weight").alias("z"), F.min("units").alias("m")).collect():
        assert r.s == (0 if r.z else units) and r.m >= 0


def test_padding_round_trip(spark):
    rows = [(g, p, p * 10) for g in range(5) for p in range(g + 1)]
    df = spark.createDataFrame(rows, "g long, p long, s long")
    packed = reshape.assemble_game_rows(df, ["g"], [F.desc("s")], ["p", "s"], 15)
    assert all(len(r.players) == len(r.mask) == 15 for r in packed.collect())
    back = reshape.explode_game_rows(packed, ["g"], ["p", "s"])
    assert sorted((r.g, r.p, r.s) for r in back.collect()) == sorted(rows)


def test_rest_days_and_dense_schedule(spark):
    days = [1, 2, 4, 5, 30]
    df = spark.createDataFrame([(1, i, datetime.date(2020, 1, d)) for i, d in enumerate(days)], "team_id long, game_id long, game_date date")
    out = {r.game_id: r for r in context.schedule_load(df).collect()}
    assert [out[i].rest_days for i in range(5)] == [None, 1, 2, 1, 5]
    assert [out[i].b2b for i in range(5)] == [0, 1, 0, 1, 0]
    assert [out[i].three_in_four for i in range(5)] == [0, 0, 1, 1, 0]
    assert [out[i].four_in_six for i in range(5)] == [0, 0, 0, 1, 0]


def test_last_meeting_flips_sides(spark):
    rows = [(1, datetime.date(2020, 1, 1), 5, 3, 10), (2, datetime.date(2020, 1, 2), 3, 5, 4), (3, datetime.date(2020, 1, 3), 5, 3, 0)]
    out = matchup.last_meeting_margin(spark.createDataFrame(rows, "game_id long, game_date date, home_team long, away_team long, margin int"))
    assert [r.h2h_last_margin for r in out.orderBy("game_id").collect()] == [0, -10, -4]


def test_asof_join_is_strict_on_request(spark):
    d = lambda n: datetime.date(2020, 1, n)
    left = spark.createDataFrame([(1, d(2), "a"), (1, d(3), "b"), (2, d(3), "c")], "k long, day date, x string")
    right = spark.createDataFrame([(1, d(2), 7), (1, d(1), 6)], "k long, day date, v int")
    strict = joins.asof_join(left, right, ["k"], "day", ["v"])
    loose = joins.asof_join(left, right, ["k"], "day", ["v"], strict=False)
    assert {r.x: r.asof_v for r in strict.collect()} == {"a": 6, "b": 7, "c": None}
    assert {r.x: r.asof_v for r in loose.collect()} == {"a": 7, "b": 7, "c": None}


def test_splits_do_not_overlap(spark):
    df = spark.createDataFrame([(1995,), (2000,), (2030,)], "season int")
    out = reshape.assign_split(df, {"train": [1995], "val": [2000]})
    assert {r.season: r.split for r in out.collect()} == {1995: "train", 2000: "val", 2030: None}
    reshape.assert_no_season_overlap(out)
    with pytest.raises(ValueError):
        reshape.assign_split(df, {"train": [1995], "val": [1995]})


def test_constraints_hold_after_projection(spark):
    rng = random.Random(5)
    names = ["fgm", "fga", "tpm", "tpa", "ftm", "fta", "oreb", "dreb", "reb"]
    rows = [tuple(rng.randint(-3, 12) for _ in names) for _ in range(200)]
    out = baseline.project_to_constraints(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)), names)
    bad = "fgm > fga or tpm > tpa or ftm > fta or tpm > fgm or tpa > fga or oreb + dreb <> reb or least(fgm, fga, tpm, tpa, ftm, fta, oreb, dreb) < 0"
    assert out.where(bad).count() == 0


def test_saved_model_predicts_the_same(spark, tmp_path):
    rng = random.Random(6)
    df = spark.createDataFrame([(float(rng.randrange(10)), rng.random(), rng.random()) for _ in range(200)], "y double, a double, b double")
    model = baseline.fit_poisson(df, "y", ["a", "b"])
    baseline.save_model(model, str(tmp_path / "m"))
    one, two = (baseline.predict(m, df, ["a", "b"]).agg(F.sum("pred")).first()[0] for m in (model, baseline.load_model(str(tmp_path / "m"))))
    assert one == pytest.approx(two) and one == pytest.approx(df.agg(F.sum("y")).first()[0], rel=1e-6)


def test_prediction_keeps_rows_with_nulls(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(float(rng.randrange(9)), rng.random(), rng.random()) for _ in range(60)], "y double, a double, b double")
    odd = df.unionByName(spark.createDataFrame([(1.0, None, 0.5), (None, 0.2, 0.1)], df.schema))
    out = baseline.predict(baseline.fit_poisson(odd, "y", ["a", "b"]), odd, ["a", "b"])
    assert out.count() == 62 and out.where("pred is null").select("a").collect() == [(None,)]
    assert out.where("y is not null and a is not null").agg(F.sum("pred") - F.sum("y")).first()[0] == pytest.approx(0, abs=1e-6)


def test_group_means_fill_nulls(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("x", None), (None, None), (None, 5.0), ("z", None)], "g string, v double")
    out = baseline.null_policy(df, ["v"], "mean", ["g"])
    assert out.columns == ["g", "v", "v_missing"]
    assert sorted(((r.g or "", r.v or 0, r.v_missing) for r in out.collect())) == [("", 5.0, 0), ("", 5.0, 1), ("x", 1.0, 0), ("x", 2.0, 1), ("x", 3.0, 0), ("z", 0, 1)]


def test_repeated_key_in_a_batch(spark, tmp_path):
    from boxlake.streaming.ingest import merge_batch

    rows = [(1, 2020, 5, 9), (1, 2020, 7, 2), (1, 2020, 7, 1), (2, 2020, 1, 1)]
    for n, some in enumerate((rows, rows[::-1])):
        df = spark.createDataFrame(some, "game_id long, season int, at int, v int")
        merge_batch(df, str(tmp_path / f"o{n}"), ["game_id"], "season", order=["at"])
        assert sorted((r.game_id, r["at"], r.v) for r in spark.read.parquet(str(tmp_path / f"o{n}")).collect()) == [(1, 7, 2), (2, 1, 1)]


def test_few_files_for_each_partition(spark, tmp_path):
    from boxlake.sources.raw import write_interim

    write_interim(spark.range(4000).selectExpr("id", "cast(id % 5 as int) as season").repartition(16), str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("season=*/*.parquet"))) == 5


def test_shared_folder_is_not_guessed_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from boxlake.sources.raw import shared_folder

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_ingest_twice_and_backfill(spark, tmp_path):
    from boxlake.streaming.ingest import ingest_incremental

    schema = "game_id long, season int, v int"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, 2020, 1), (2, 2021, 1)], schema).write.parquet(source)
    run = lambda: ingest_incremental(spark, source, out, state, spark.createDataFrame([], schema).schema, lambda b: b, ["game_id"])
    run()
    run()
    spark.createDataFrame([(3, 2021, 5), (2, 2021, 9)], schema).write.mode("append").parquet(source)
    run()
    assert sorted((r.game_id, r.season, r.v) for r in spark.read.parquet(out).collect()) == [(1, 2020, 1), (2, 2021, 9), (3, 2021, 5)]
