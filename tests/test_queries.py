"""Every query of the workload against its oracle SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
from faultscope.workload import ORACLES, QUERIES
from tests.oracle import compare

SF = os.environ.get("FAULTSCOPE_TEST_SF", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_oracle(spark, name):
    sql, fn = ORACLES.get(name), QUERIES[name]
    if sql is None:
        assert fn(spark, SF).columns
    else:
        assert compare(spark, fn, sql, SF) is None


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


def test_entry_gives_rows(spark):
    assert entry_point.entry(spark).limit(1).count() == 1
