from pyspark.sql import functions as F

from assayist.llm.mixing import TOKENIZER, largest_total, mixed, route, shares, shipped, token_counts


def test_flow_spreads_repetition():
    patterns = {("a",): 100, ("a", "b"): 100, ("b",): 50}
    targets = {"a": (0.5, 3), "b": (0.5, 3)}
    total, flows = route(patterns, targets, 240)
    assert total == 240 and sum(f for (p, s), f in flows.items() if s == "a") == 120 and sum(f for (p, s), f in flows.items() if s == "b") == 120
    assert all(sum(f for (q, _), f in flows.items() if q == p) <= t for p, t in patterns.items())  # nothing is used twice
    assert largest_total(patterns, targets) in (750, 751)
    assert route(dict(reversed(patterns.items())), targets, 240) == (total, flows)
    assert largest_total({}, targets) == 0


def test_mix(spark):
    words = lambda n, k: " ".join(f"word{k}" for _ in range(n))
    rows = [(i, words(20, i), "big") for i in range(60)] + [(100 + i, words(20, 500 + i), "Small") for i in range(6)] + [(200, words(20, 0), " small"), (201, None, "big"), (202, "", "big"), (203, words(9, 9), "other"), (204, words(9, 9), None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixed(docs, targets)
    got = mix.collect()
    assert {r.source for r in got} == {"big", "small"} and all(r.times <= {"big": 2, "small": 3}[r.source] for r in got) and not {201, 202, 203, 204} & {r.doc_id for r in got}
    report = {r.source: r for r in shares(mix, targets).collect()}
    assert abs(report["big"].actual_share / report["small"].actual_share - 2) < 0.25 and report["absent"].tokens == 0 and report["small"].most_used == 3
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixed(docs, targets).collect()))
    assert mixed(docs.limit(0), targets).count() == 0 and mixed(docs, targets.limit(0)).count() == 0
    assert spark.createDataFrame([("a b",), (None,)], "t string").select(token_counts(shipped(spark, TOKENIZER))(F.col("t")).alias("n")).agg(F.sum("n")).first()[0] == 2
