from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayist.operators.delivery import DeliveryIndex, deliver_once, identifier, index_deliveries, repeated_deliveries

T0 = datetime(2024, 1, 1)
A, B = "0123456789abcdef0123456789abcdef", "ffffffffffffffffffffffffffffff00"
SCHEMA = "delivery_id bigint, evaluation_id string, delivered_at timestamp, kept string, _t int"


def test_identifier(spark):
    spelled = [A, A.upper(), f"{{{A}}}", f"urn:uuid:{A[:8]}-{A[8:12]}-{A[12:16]}-{A[16:20]}-{A[20:]}", f"  {A} ", "0x" + A]
    df = spark.createDataFrame([(s,) for s in [*spelled, "", "  ", None, "odd id", "ODD  ID"]], "s string").select(F.hex(identifier(F.col("s"))).alias("h"))
    got = [r.h for r in df.collect()]
    assert set(got[:6]) == {A.upper()} and got[6:9] == [None] * 3 and got[9] == got[10] is not None


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([A, A.upper(), B, None, "", "x"]), st.one_of(st.none(), st.integers(0, 50))), max_size=40))
def test_against_brute_force(spark, rows):
    """Nulls in any column, ties, repeated times, clashing columns; a copy in another batch counts, too."""
    data = [(i, e, None if t is None else T0 + timedelta(hours=t), "clash", 1) for i, (e, t) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    best: dict = {}
    for i, e, t, *_ in data:
        if e:
            k = e.lower()
            best[k] = min(best.get(k, (True, datetime.max, 1 << 60)), (t is None, t or datetime.max, i))
    want = {i for i, e, *_ in data if e} - {v[2] for v in best.values()}
    assert {r[0] for r in repeated_deliveries(df, "evaluation_id", "delivered_at", "delivery_id", batches=3, merge_every=2).collect()} == want


def test_once_and_empty(spark):
    df = spark.createDataFrame([(1, A, T0, "a", 0), (2, A, T0, "b", 0), (3, None, T0, "c", 0), (4, None, None, "d", 0)], SCHEMA)
    assert sorted(r.delivery_id for r in deliver_once(df, "evaluation_id", "delivered_at", "delivery_id").collect()) == [1, 3, 4]
    assert deliver_once(df.limit(0), "evaluation_id", "delivered_at", "delivery_id").count() == 0


def test_index_takes_batches_as_they_come(spark):
    index = DeliveryIndex(spark, prefix_bits=2, merge_every=3)
    for k in range(4):
        batch = spark.createDataFrame([(bytes([i]) + b"\0" * 15, i + 100 * k) for i in range(k, k + 5)], "key binary, d bigint")
        index.add(batch, "key", ["d"], "d")
    assert sorted(r.kept for r in index.kept().collect()) == [0, 1, 2, 3, 4, 105, 206, 307]
    assert len(index.runs) <= 3 and {v for _, v in index.runs} == {0, 1}
    assert index_deliveries(spark.createDataFrame([], SCHEMA), "evaluation_id", "delivered_at", "delivery_id")[0].kept().count() == 0


def test_another_session_goes_on(spark):
    """The index is opened from its folder; a batch that touches one prefix reads that prefix only."""
    rows = lambda a, b, k: spark.createDataFrame([(bytes([i]) * 16, i + k) for i in range(a, b)], "key binary, d bigint")
    index = DeliveryIndex(spark, prefix_bits=3)
    index.add(rows(0, 40, 0), "key", ["d"], "d")
    again = DeliveryIndex.open(spark.newSession(), index.root)
    assert again.bits == 3 and again.runs == index.runs
    again.add(again.spark.createDataFrame(rows(35, 45, 100).collect(), "key binary, d bigint"), "key", ["d"], "d")
    assert sorted(r.kept for r in DeliveryIndex.open(spark, index.root).kept().collect()) == [*range(40), *range(140, 145)]
    plan = index._read(index.runs, [2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan and "prefix#" in plan
    with pytest.raises(Exception, match="lists"):
        DeliveryIndex.open(spark, DeliveryIndex(spark, 1).root + "-none")
