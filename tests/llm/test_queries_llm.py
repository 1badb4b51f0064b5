"""Every query of this subpackage over the smallest tables, against its SQL where there is one."""

import pytest

import __spark_entry__ as entry
from assayist.llm import queries
from tests.oracle import rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = rows_of_spark(entry.queries()[name](spark, SF))
    if sql := entry.oracle_sql().get(name):
        assert got == rows_of_sql(sql, SF)


def test_found_columns(spark):
    want = {"p1_found": ["finding_id"], "p3_found": ["model_version", "week_start", "cache_hit", "metric_name", "pct"], "p5_found": ["application_id_a", "application_id_b"], "p6_found": ["finding_id", "side", "entry_id"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "subject_id"]}
    for name, columns in want.items():
        assert entry.queries()[name](spark, SF).columns == columns
