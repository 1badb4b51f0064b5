from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assayist.functions import text as X
from assayist.operators import engine, validators, verdict, windows
from assayist.operators.validators import Inputs


def outcome(spark, name, reading, expected=None, seen=True, parameters=None, **extra):
    lit = lambda v: v if not isinstance(v, (str, type(None), bool, float, int, Decimal)) else F.lit(v)
    i = Inputs(F.lit(reading).cast("string"), F.lit(expected).cast("string"), F.lit(seen), {k: lit(v) for k, v in extra.items()}, parameters or {})
    r = spark.range(1).select(validators.run(name, i).alias("v")).first().v
    return r.outcome, r.code


def test_registry():
    assert len(validators.REGISTRY) == 14
    with pytest.raises(ValueError):
        validators.register("presence")(lambda i: None)


def test_presence(spark):
    assert outcome(spark, "presence", "x")[0] == "PASS"
    assert outcome(spark, "presence", None, seen=False)[0] == "INSUFFICIENT"
    assert outcome(spark, "presence", "", seen=True)[0] == "FAIL"
    assert outcome(spark, "presence", " ", seen=False, parameters={"unlocated_is_absent": True})[0] == "FAIL"
    assert outcome(spark, "nothing", "x") == ("ERROR", "ENGINE.VALIDATOR.NOT_FOUND")
    assert outcome(spark, "unmeasurable", "x")[0] == "INSUFFICIENT"


def test_designation(spark):
    p = {"classes": ["vodka", "straight rye whiskey", "rye whiskey", "ale", "beer"], "within": [("ale", "beer")]}
    check = lambda r, e: outcome(spark, "designation", r, e, parameters=p)[0]
    assert check("Small Batch Straight Rye Whisky", "straight rye whiskey") == "PASS"
    assert check("ALE", "beer") == "PASS"
    assert check("vodka", "ale") == "FAIL"
    assert check("fine vodka", "ale") == "INSUFFICIENT"
    assert check("vodka", None) == "NOT_APPLICABLE"
    assert check("", "ale") == "FAIL"


def test_brand(spark):
    check = lambda r, e, s=0.0: outcome(spark, "brand", r, e, similarity=s)
    assert check("STONE'S THROW", "Stone’s Throw")[0] == "PASS"
    assert check("The Old Mill Distillery", "Old Mill")[0] == "PASS"
    assert check("OLD-MILL", "Old Mill")[0] == "PASS"
    assert check("Ald Mill", "Old Mill") == ("INSUFFICIENT", "BRAND.NEAR")
    assert check("Other", "Old Mill", 0.93)[0] == "PASS"
    assert check("Other", "Old Mill", 0.86)[1] == "BRAND.NEAR"
    assert check("Other", "Old Mill")[1] == "BRAND.UNCERTAIN"
    assert check("Other", None)[0] == "NOT_APPLICABLE"


def test_style_layout_and_address(spark):
    h = {"heading": "GOVERNMENT WARNING"}
    assert outcome(spark, "heading_style", "Government Warning", parameters=h, all_caps=True, bold=True, confident=True)[0] == "PASS"
    assert outcome(spark, "heading_style", "Government Warning", parameters=h, all_caps=False, bold=True, confident=True)[0] == "FAIL"
    assert outcome(spark, "heading_style", "Government Warning", parameters=h, all_caps=True)[0] == "INSUFFICIENT"
    panels = F.create_map(F.lit("front"), F.array(F.lit("brand"), F.lit("class")), F.lit("back"), F.array(F.lit("abv")))
    assert outcome(spark, "same_field_of_vision", "", parameters={"fields": ["brand", "class"]}, panels=panels)[0] == "PASS"
    assert outcome(spark, "same_field_of_vision", "", parameters={"fields": ["brand", "abv"]}, panels=panels)[0] == "FAIL"
    a = {"states": {"new york": "ny", "kentucky": "ky"}}
    assert outcome(spark, "name_address", "Bottled by Old Mill Co, Albany, New York", "Old Mill Company, 1 Main St, Albany NY", parameters=a)[0] == "PASS"
    assert outcome(spark, "name_address", "Bottled by Other Co, Albany", "Old Mill Company, Albany NY", parameters=a)[0] == "INSUFFICIENT"
    assert outcome(spark, "origin", "Product of France", "France", imported=True)[0] == "PASS"
    assert outcome(spark, "origin", "x", "France", imported=None)[0] == "NOT_APPLICABLE"


def test_proof_verbatim_quantity(spark):
    proofs = lambda *v: F.array(*(F.struct(F.lit(a).alias("value"), F.lit(b).alias("beside")) for a, b in v))
    check = lambda abv, *v: outcome(spark, "proof_agreement", "", abv=abv, proofs=proofs(*v))[0]
    assert check(40.0, ("80", True)) == "PASS"
    assert check(40.0, ("80", True), ("90", True)) == "FAIL"
    assert check(40.0, ("90", False)) == "INSUFFICIENT"
    assert check(40.0, ("180", True)) == "INSUFFICIENT"  # an extra 1 read
    assert check(None, ("80", True)) == "INSUFFICIENT"
    t = {"text": "Keep away from fire.", "words": "keep away from fire near the please".split()}
    assert outcome(spark, "verbatim", "KEEP  AWAY from\nfire.", parameters=t)[0] == "PASS"
    assert outcome(spark, "verbatim", "Keep away from fyre.", parameters=t)[0] == "INSUFFICIENT"
    assert outcome(spark, "verbatim", "Keep away near fire.", parameters=t)[0] == "FAIL"
    assert outcome(spark, "verbatim", "Keep fyre away from.", parameters={"text": t["text"]})[0] == "FAIL"  # without a list of words
    q = lambda a, u, d: outcome(spark, "quantity", "", "x", parameters={"factors": {"ml": 1.0, "l": 1000.0}, "cross": 0.01}, amount=a, unit=u, declared=d)[0]
    assert [q(750.0, "ml", 750.0), q(0.755, "l", 750.0), q(751.0, "ml", 750.0), q(1.0, "barrel", 750.0), q(None, "ml", 750.0)] == ["PASS", "PASS", "FAIL", "INSUFFICIENT", "INSUFFICIENT"]
    assert outcome(spark, "quantity", "", "x", parameters={"factors": {"ml": 1.0, "l": 1000.0}}, amount=0.755, unit="l", declared=750.0)[0] == "FAIL"  # no margin unless a rule gives one


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(X.shortened(X.norm_words(F.lit("Old Mill Distilling Company")), ["company", "distilling"])) == ["old", "mill"]
    assert one(X.shortened(X.norm_words(F.lit("Company")), ["company"])) == []
    assert [one(X.search_route(F.lit(f), F.lit("Old Mill Company"), ["company"])) for f in ("old mill company", "fine old mill company rye", "an old mill", "old mill", "OldMill Company", "old mil company", "other")] == [1, 3, None, 4, 2, 5, None]
    assert one(X.trade_names(F.lit("A Co, 1 Main St, Albany NY 12345 Blue Hen (Used on label), Red Hen (used on label)"))) == ["Blue Hen", "Red Hen"]
    assert [(c.title, c.section, c.paragraph) for c in one(X.citations(F.lit("27 CFR §5.63(a)(1), §5.65, 28 CFR §16.21")))] == [(27, "5.63", "(a)(1)"), (27, "5.65", None), (28, "16.21", None)]
    assert one(X.citations(F.lit("27 CFR §5.63, nonsense"))) is None and one(X.citations(F.lit("27 CFR 5.63"))) is None
    assert one(X.framed(F.lit("ab"), F.lit("c"))) != one(X.framed(F.lit("a"), F.lit("bc")))
    assert one(X.version_key(F.lit("0.10.0")) > X.version_key(F.lit("0.2.0")))
    assert one(X.nfkc()(F.lit("ﬁ"))) == "fi"
    assert one(X.sorted_json({"b": F.lit(1), "a": F.lit("x")})) == '{"a":"x","b":1}'
    with pytest.raises(ValueError):
        X.apply_ops(F.lit("x"), ["unknown"])


def test_verdicts(spark):
    df = spark.createDataFrame([("a", None), ("b", "pass"), ("b", "not_applicable"), ("c", "pass"), ("c", "needs_review"), ("d", "fail"), ("d", "needs_review"), ("e", "not_applicable")], "k string, d string")
    assert {r.k: r.v for r in df.groupBy("k").agg(verdict.lattice(F.col("d")).alias("v")).collect()} == {"a": "needs_review", "b": "pass", "c": "needs_review", "d": "fail", "e": "pass"}
    o = spark.createDataFrame([("c", "pass", 1, 1), ("c", "fail", 2, 1), ("c", "pass", 2, 0)], "k string, applied string, ts int, seq int")
    v = spark.createDataFrame([("c", "needs_review"), ("d", "fail")], "k string, disposition string")
    assert {r.k: (r.disposition, r.overridden) for r in verdict.corrected(v, o, ["k"], ["ts", "seq"]).collect()} == {"c": ("fail", True), "d": ("fail", False)}
    assert spark.range(1).select(verdict.rule_disposition(F.lit("ERROR"), F.lit("reject")).alias("v")).first().v == "needs_review"


def test_recurring_with_nulls(spark):
    codes = ["a", None, "a", "a", None, "a", "a", "b"]
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(codes)], "k int, i int, c string")
    assert [(r.i, r.times) for r in windows.recurring(df, "k", ["i"], "c").collect()] == [(6, 5)]
    assert windows.first_advisory(df, "k", ["i"], "c").first().advisory_code == "a"


def test_unknown_rule_is_an_error_result(spark):
    df = spark.createDataFrame([("x", "a")], "field_name string, v string")
    r = engine.checked(df, [{"rule_id": "r", "field": "x", "validator": "none", "severity": "reject"}], lambda r: Inputs(F.col("v"))).first()
    assert (r.outcome, r.rule_id) == ("ERROR", "r")
