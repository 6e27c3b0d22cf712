"""Every driver query against its reference SQL, on the smallest tables."""

import os

import pytest
from compare import difference, duck
from conftest import plan

import __spark_entry__ as entry
from driver_queries.oracles import all_oracles
from driver_queries.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_reference_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF_DIR)
    assert difference(df, con, all_oracles()[name]) == ""
    text = plan(df)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert unwanted not in text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == entry.queries()["q_posting_measure"](spark, SF_DIR).columns
    assert df.count() > 0
