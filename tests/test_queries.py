"""Every registered query with an oracle gives the oracle's rows on the smallest tables."""

import pytest
from conftest import SMALL, same_rows

from boxlake.plans import entries


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_equals_oracle(spark, duck, name):
    same_rows(entries.QUERIES[name](spark, SMALL), duck.sql(entries.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(entries.QUERIES) - set(entries.ORACLES)))
def test_model_queries_give_rows(spark, name):
    rows = entries.QUERIES[name](spark, SMALL).collect()
    assert rows and all(r.pred > 0 for r in rows)


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
