"""Every registered query against its SQL counterpart, and invariants for those without one."""

import pytest
from compare import differences, sql_connection

from twinsight.plans.catalog import QUERIES
from twinsight.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(data):
    return sql_connection(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, con, name):
    assert differences(QUERIES[name](spark, data), con, ORACLES[name], tolerance=2e-6) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_one_row_per_strategy(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == [
        "segment", "discount", "threshold", "roi_real", "roi_syn", "decision_real", "decision_syn", "agree",
    ]
    assert df.count() == 48
