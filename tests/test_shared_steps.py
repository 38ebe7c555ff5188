"""Steps that many queries share read and deal their tables once, and keep a task's memory bounded."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from boxlake.operators import checks
from boxlake.plans import bridge, entries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tbox", "pbox"])
def test_lines_are_dealt_once(spark, name):
    """No exchange of lines but the one by game, up to players and teams."""
    view = bridge.view(spark, SMALL, name)
    assert _plan(view).count("Exchange hashpartitioning") <= 2


def test_parts_grow_with_lines(spark, monkeypatch):
    monkeypatch.setattr(bridge, "TASK_LINES", 100)
    assert int(re.search(r"Exchange hashpartitioning\(l_orderkey#\d+L, (\d+)\)", _plan(bridge.view(spark, SMALL, "pbox")))[1]) >= 60


def test_checks_are_compiled(spark):
    """No functions over arrays, which Spark interprets; conditions stay above the columns that they judge."""
    for df in checks.validate(entries._box(spark, SMALL), entries._box_checks()):
        assert "lambda" not in _plan(df) and re.search(r"Filter [^\n]*_failed", _plan(df))


def test_checks_name_what_fails(spark):
    rows = spark.createDataFrame([(1, 3.0, 2.0, 5.0), (2, 1.5, 2.0, 5.0), (3, None, None, None), (4, float("nan"), 2.0, -1.0)], "id long, a double, b double, c double")
    some = {"a_le_b": F.col("a") > F.col("b"), "non_negative": F.least("a", "b", "c") < 0, "integral": checks._any(F.col(x) % 1 != 0 for x in "abc")}
    valid, rejected = checks.validate(rows, some)
    assert [r.id for r in valid.collect()] == [3] and valid.columns == rows.columns
    assert {r.id: r.violations for r in rejected.collect()} == {1: ["a_le_b"], 2: ["integral"], 4: ["a_le_b", "non_negative", "integral"]}
    assert {r.id: r.violations for r in checks.with_violations(rows, {}).collect()} == {i: [] for i in (1, 2, 3, 4)}
