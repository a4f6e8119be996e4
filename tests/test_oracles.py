"""Every registered query against its SQL equivalent."""

import pytest
from compare import compare, connect
from conftest import SAMPLE

import __spark_entry__ as entry_module
from trailmark.plans.catalog import QUERIES
from trailmark.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SAMPLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SAMPLE)
    if name in ORACLES:
        equal, message = compare(df, con, ORACLES[name])
        assert equal, message
    else:
        assert df.count() > 0


def test_all_oracles_have_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"storage_report"}


def test_entry_lists_all():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
