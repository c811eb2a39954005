"""Every query against its SQL counterpart on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_module

# The optional text queries have tests of their own.
QUERIES = {k: q for k, q in entry_module.queries().items() if k not in entry_module.TEXT_QUERIES}
ORACLES = {k: q for k, q in entry_module.oracle_sql().items() if k in QUERIES}
#: Thresholds on the smallest tables leave these empty; sf0.01 has rows.
MAY_BE_EMPTY = {"alerts_published_recent", "departments_at_risk", "alerts_latest_week", "alerts_weekly_table"}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, folder, name):
    actual = QUERIES[name](spark, folder).toPandas()
    assert differences(actual, con.sql(ORACLES[name]).df()) == []
    assert len(actual) or name in MAY_BE_EMPTY


def test_only_forests_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"forest_train_score", "forest_per_disease"}
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
