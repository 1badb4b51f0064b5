import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayist.llm import dyadic
from assayist.llm.dyadic import Shape, Sketch

SHAPE = Shape()


@given(st.integers(1, 2**31 - 1), st.integers(1, 2**31 - 1))
def test_codes_keep_order_and_are_close(a, b):
    ca, cb = SHAPE.code(a), SHAPE.code(b)
    assert (a <= b) == (ca <= cb) or ca == cb
    assert a <= SHAPE.decode(ca) <= a * (1 + 2**-SHAPE.mantissa) and 0 <= ca < 1 << SHAPE.levels


def test_encode_is_code(spark):
    values = [1, 2, 511, 512, 513, 1023, 1024, 5000, 10**6, 2**31 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v int").select("v", SHAPE.encode(F.col("v")).alias("c"))
    assert all(r.c == SHAPE.code(r.v) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_merge_delete_and_error(seed):
    rng = np.random.default_rng(seed)
    values = np.maximum(1, rng.lognormal(7.5, 1.2, 20_000)).astype(np.int64)
    gone = values[:500]
    codes = np.array([SHAPE.code(v) for v in values])
    parts = [Sketch(SHAPE).add(c, np.ones(len(c), np.int64)) for c in np.array_split(codes, 7)]
    whole = Sketch(SHAPE).add(codes, np.ones(len(codes), np.int64))
    total = parts[0]
    for p in parts[1:]:
        total.merge(p)
    assert (total.data == whole.data).all() and total.n == len(values)
    total.add(codes[:500], np.full(500, -1))
    rest = np.sort(values[500:])
    assert total.n == len(rest) and len(gone) == 500
    for pct in (1, 10, 50, 90, 99):
        rank = -(-pct * len(rest) // 100)
        got = SHAPE.decode(total.quantile(rank))
        lo, hi = np.searchsorted(rest, got / (1 + 2**-8), "left"), np.searchsorted(rest, got, "right")
        assert lo - total.error() <= rank <= hi + total.error() + 1
    for v in (100, 1000, 5000):
        assert abs(total.rank(SHAPE.code(v)) - sum(np.array([SHAPE.code(x) for x in rest]) < SHAPE.code(v))) <= total.error()


def test_plan(spark):
    rows = [(f"e{i}", "m", "2024-01-03 00:00:00", True, i, None) for i in range(1, 101)] + [("e1", "m", "2024-01-03 00:00:00", True, 1, None), ("x", None, "2024-01-03 00:00:00", True, 5, 5), ("y", "m", None, True, 5, 5), ("z", "m", "2024-01-07 23:59:59", True, -5, 0)]
    df = spark.createDataFrame(rows, "evaluation_id string, model_version string, t string, cache_hit boolean, total_duration_ms int, vision_duration_ms int").withColumn("started_at", F.to_timestamp("t")).withColumn("day", F.lit("clash"))
    keys = ["model_version", "week_start", "cache_hit", "metric_name"]
    values = dyadic.unpivoted(df)
    out = dyadic.merged(dyadic.sketches(dyadic.coded(values, keys, "day", "value"), [*keys, "day"]), keys, [50, 90]).collect()
    assert [(r.week_start, r.pct, r.n) for r in sorted(out, key=lambda r: r.pct)] == [("2024-01-01", 50, 100), ("2024-01-01", 90, 100)]
    assert all(abs(r.value - r.pct) <= max(2, r.rank_error) for r in out)
    assert dyadic.unpivoted(df.limit(0)).count() == 0


def test_small_sketches_are_codes_and_add_up_alike():
    rng = np.random.default_rng(5)
    few, many = rng.integers(1, 9000, 40), rng.integers(1, 9000, 5000)
    blobs = [Sketch.stored(SHAPE, x, np.ones(len(x), np.int64)) for x in (few, many)]
    assert [n for n, _ in blobs] == [40, 5000] and len(blobs[0][1]) < len(blobs[1][1]) == 8 * (SHAPE.size + 1)
    both = np.concatenate([few, many])
    assert (Sketch.of(SHAPE, [b for _, b in blobs]).data == Sketch(SHAPE).add(both, np.ones(len(both), np.int64)).data).all()
    assert Sketch.of(SHAPE, []).n == 0


def test_a_value_beyond_the_shape_is_refused(spark):
    df = spark.createDataFrame([(2**41,)], "v bigint")
    with pytest.raises(Exception, match="wider shape"):
        df.select(SHAPE.encode(F.col("v"))).collect()
    wide = Shape(value_bits=42)
    assert df.select(wide.encode(F.col("v")).alias("c")).first().c == wide.code(2**41)


def _counts(spark, seed, at_most=None):
    rng = np.random.default_rng(seed)
    rows = [(f"g{g}", int(d), int(v)) for g in range(12) for d, v in zip(rng.integers(0, 3, 400), rng.lognormal(8.3 + 0.02 * g, 0.3, 400), strict=True)] + [("g0", 0, 5000)] * 50 + [(None, 0, 5001)] * 60
    values = spark.createDataFrame(rows, "g string, day int, value int")
    return rows, dyadic.coded(values, ["g"], "day", "value", at_most=F.when(F.col("value") <= 5000, 1).otherwise(0) if at_most is None else F.lit(at_most))


def _exact(rows, pcts, groups):
    out = set()
    for g in groups:
        v = sorted(x for k, _, x in rows if k == g)
        out |= {(g, p) for p in pcts if v[-(-p * len(v) // 100) - 1] > 5000}
    return out


def test_above_is_exact_and_the_sketches_decide(spark):
    pcts = [25, 50, 75, 90]
    rows, counts = _counts(spark, 3)
    want = _exact(rows, pcts, {r[0] for r in rows})
    run = lambda c: {tuple(r) for r in dyadic.above(c, ["g"], "day", pcts, 5000, 40, "at_most").collect()}
    assert run(counts) == want
    # with the exact counts spoilt only the groups within the rank's error of the limit change
    t = dyadic.merged(dyadic.sketches(counts, ["g", "day"]), ["g"], pcts, above=5000).collect()
    sure = {(r.g, r.pct) for r in t if r.n_most + r.rank_error < -(-r.pct * r.n // 100)}
    assert len(sure) > 5 and run(_counts(spark, 3, 1)[1]) == sure
    # and with the sketches spoilt (one counter a row) all are counted exactly
    narrow = Shape(depth=1, width=1)
    assert {tuple(r) for r in dyadic.above(counts, ["g"], "day", pcts, 5000, 40, "at_most", narrow).collect()} == want
