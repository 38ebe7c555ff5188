"""Merging batches: nulls, text partitions, keys that move, corrected headers; only touched partitions change."""

import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxlake.operators import rolling
from boxlake.streaming.ingest import merge_batch, refresh_affected, stored

ROWS = "id long, season int, v int"


def held(spark, path, partition="season", kind=None):
    return sorted((tuple(r) for r in stored(spark, path, partition, kind or T.IntegerType()).select("id", partition, "v").collect()), key=repr)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_keys" not in d}


def test_null_partition_loses_no_row(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_batch(spark.createDataFrame([(1, 2000, 1), (2, None, 1)], ROWS), path, ["id"], "season")
    merge_batch(spark.createDataFrame([(3, None, 1)], ROWS), path, ["id"], "season")
    assert held(spark, path) == [(1, 2000, 1), (2, None, 1), (3, None, 1)]
    merge_batch(spark.createDataFrame([(2, 2000, 5), (3, None, 6)], ROWS), path, ["id"], "season")
    assert held(spark, path) == [(1, 2000, 1), (2, 2000, 5), (3, None, 6)]


def test_text_partition_keeps_its_form(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, season string, v int"
    for rows in ([(1, "007", 1), (2, "007", 1), (4, "a b/c=%", 1)], [(3, "007", 1), (5, "", 1), (6, "7", 1)], [(2, "007", 9), (4, "a b/c=%", 9), (6, "007", 9), (5, None, 9)]):
        merge_batch(spark.createDataFrame(rows, schema), path, ["id"], "season")
    assert held(spark, path, kind=T.StringType()) == sorted([(1, "007", 1), (2, "007", 9), (3, "007", 1), (4, "a b/c=%", 9), (5, None, 9), (6, "007", 9)], key=repr)
    assert not os.path.exists(f"{path}/season=7")


def test_moved_key_leaves_its_old_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_batch(spark.createDataFrame([(1, 2000, 1), (2, 2000, 1), (3, 1999, 1), (4, 1998, 1)], ROWS), path, ["id"], "season")
    before = files(path)
    for _ in range(2):  # once more: nothing changes
        merge_batch(spark.createDataFrame([(1, 2001, 2), (3, 2001, 2)], ROWS), path, ["id"], "season")
        assert held(spark, path) == [(1, 2001, 2), (2, 2000, 1), (3, 2001, 2), (4, 1998, 1)]
    assert not os.path.exists(f"{path}/season=1999")
    untouched = {f: t for f, t in before.items() if "season=1998" in f}
    assert untouched and untouched.items() <= files(path).items()


def test_batch_is_run_again_after_a_failure_before_the_index(spark, tmp_path, monkeypatch):
    from boxlake.streaming import ingest

    path = str(tmp_path / "t")
    merge_batch(spark.createDataFrame([(1, 2000, 1), (2, 2000, 1)], ROWS), path, ["id"], "season")
    batch, write = spark.createDataFrame([(1, 2001, 2), (5, 2000, 2)], ROWS), ingest.write_interim

    def fails_at_the_index(df, at, partition="season"):
        if at.endswith("_keys"):
            raise OSError("lost")
        write(df, at, partition)

    monkeypatch.setattr(ingest, "write_interim", fails_at_the_index)
    with pytest.raises(OSError):
        merge_batch(batch, path, ["id"], "season")
    monkeypatch.undo()
    merge_batch(batch, path, ["id"], "season")
    assert held(spark, path) == [(1, 2001, 2), (2, 2000, 1), (5, 2000, 2)]


def test_null_and_composite_keys(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, k string, season int, v int"
    merge_batch(spark.createDataFrame([(None, "a", 2000, 1), (1, None, 2000, 1), (None, None, 2001, 1)], schema), path, ["id", "k"], "season")
    merge_batch(spark.createDataFrame([(None, "a", 2001, 2), (None, None, None, 2), (1, "b", 2000, 2)], schema), path, ["id", "k"], "season")
    got = stored(spark, path, "season", T.IntegerType()).select("id", "k", "season", "v").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, "a", 2001, 2), (1, None, 2000, 1), (None, None, None, 2), (1, "b", 2000, 2)], key=repr)


def test_deletes_and_new_columns_and_tables_without_an_index(spark, tmp_path):
    from boxlake.sources.raw import write_interim

    path = str(tmp_path / "t")
    write_interim(spark.createDataFrame([(1, 2000, 1), (2, 2001, 1), (3, 2001, 1)], ROWS), path)
    merge_batch(spark.createDataFrame([(2, 2000, 7, "x")], ROWS + ", w string"), path, ["id"], "season", deletes=spark.createDataFrame([(3,), (9,)], "id long"))
    assert held(spark, path) == [(1, 2000, 1), (2, 2000, 7)] and not os.path.exists(f"{path}/season=2001")
    empty = spark.createDataFrame([], ROWS)
    merge_batch(empty, path, ["id"], "season", deletes=spark.createDataFrame([(1,), (2,)], "id long"))
    assert stored(spark, path, "season", T.IntegerType()) is None
    merge_batch(spark.createDataFrame([(1, 2003, 4)], ROWS), path, ["id"], "season")
    merge_batch(spark.createDataFrame([(1, 2004, 5)], ROWS), path, ["id"], "season")
    assert held(spark, path) == [(1, 2004, 5)]


def test_corrected_header_moves_features(spark, tmp_path):
    """A game that comes again with another date, season and player: features equal those built from the corrected rows alone."""
    d = lambda y, m, n: datetime.date(y, m, n)
    schema = "game_id long, player_id long, season int, game_date date, secs long"
    rows = [(i, i % 3, 2000 + i // 10, d(2000 + i // 10, 1 + i % 10, 5), 100 + i) for i in range(30)]
    fixed = [(4, 1, 2002, d(2002, 2, 7), 50), (7, 2, 2000, d(2000, 8, 5), 60), (12, 0, 2000, None, 70)]
    build = lambda df: rolling.prior_rolling(df, ["player_id"], "game_date", ["game_id"], {"s": F.col("secs")}, (3,))
    interim, features = str(tmp_path / "i"), str(tmp_path / "f")
    first = spark.createDataFrame(rows, schema)
    merge_batch(first, interim, ["game_id"], "season")
    refresh_affected(first, interim, features, "player_id", "game_date", "season", build)
    again = spark.createDataFrame(fixed, schema)
    merge_batch(again, interim, ["game_id"], "season")
    refresh_affected(again, interim, features, "player_id", "game_date", "season", build)
    want = build(spark.createDataFrame([r for r in rows if r[0] not in (4, 7, 12)] + fixed, schema))
    cols = ["game_id", "player_id", "season", "game_date", "n_3", "s_sum_3"]
    got = stored(spark, features, "season", T.IntegerType())
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_new_table_is_written_without_a_second_pass(spark, tmp_path, monkeypatch):
    """A first batch is neither kept in memory nor are its keys made distinct again; repeated keys are settled all the same."""
    from pyspark.sql.classic.dataframe import DataFrame

    calls = []
    monkeypatch.setattr(DataFrame, "persist", lambda df, *a: calls.append("persist") or df)
    monkeypatch.setattr(DataFrame, "distinct", lambda df: calls.append("distinct") or df.dropDuplicates())
    path = str(tmp_path / "t")
    merge_batch(spark.createDataFrame([(1, 2000, 1), (1, 2001, 2), (None, None, 3), (None, 2000, 1)], ROWS), path, ["id"], "season")
    assert not calls and held(spark, path) == [(1, 2001, 2), (None, 2000, 1)]
    assert spark.read.parquet(f"{path}/_keys").count() == 2
