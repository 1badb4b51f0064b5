"""Every query of the core against its SQL over the smallest tables; those without SQL must run."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"
NAMES = sorted(k for n in entry.CORE for k in __import__(n, fromlist=["QUERIES"]).QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = rows_of_spark(entry.queries()[name](spark, SF))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert sum(got[1].values()) > 0 and len(got[0]) == len(set(got[0]))
        return
    want = rows_of_sql(sql, SF)
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
