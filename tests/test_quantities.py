import math

import pytest

from assayist.operators.quantities import ABV, ML, equal_amounts, finding_readings, read_alcohol, read_bare, read_volume, solve_identity, unit_options
from pyspark.sql import functions as F


@pytest.mark.parametrize(("text", "want"), [
    ("750 ml", [(750.0, "ml")]), ("0,75 L", [(750.0, "l")]), ("1,500 ml", [(1500.0, "ml"), (1.5, "ml")]), ("NET CONT. 25.36 FL. OZ.", [(25.36 * ML["floz"], "floz")]), ("1/2 L", [(500.0, "l")]), ("1 1/2 pints", [(1.5 * ML["pint"], "pint")]),
    ("half a quart", [(0.5 * ML["quart"], "quart")]), ("ONE LITER", [(1000.0, "l")]), ("3 pt. 2.7 fl. oz.", [(3 * ML["pint"] + 2.7 * ML["floz"], "pint")]), ("0.25U.S. gallons", [(0.25 * ML["gallon"], "gallon")]), ("３３０　ｍｌ", [(330.0, "ml")]), ("10 cеntilitrеs", [(100.0, "cl")]),
    ("750", []), ("", []), ("% vol", []), ("__ fl oz", []), ("per case", []), ("x" * 100_000, []), ("1.000.000 ml", [(1e6, "ml")]),
])
def test_volume(text, want):
    got = read_volume(text)
    assert [u for _, u in got] == [u for _, u in want] and all(math.isclose(a, b) for (a, _), (b, _) in zip(got, want, strict=True))


@pytest.mark.parametrize(("text", "want"), [
    ("45% ABV", [(45.0, "percent")]), ("ALC. 6,7% BY VOL.", [(6.7, "percent")]), ("Alc. 4.1 pct. by vol.", [(4.1, "percent")]), ("86° proof", [(43.0, "proof")]), ("Proof: 36", [(18.0, "proof")]), ("92 US proof", [(46.0, "proof")]),
    ("vol. fraction 0.4", [(40.0, "fraction")]), ("0.4 (alcohol fraction by volume)", [(40.0, "fraction")]), ("alcohol 41 ml/L", [(4.1, "ml/l")]), ("400 mL alcohol per L", [(40.0, "ml/l")]), ("9", []), ("alc/vol", []),
])
def test_alcohol(text, want):
    got = read_alcohol(text)
    assert [u for _, u in got] == [u for _, u in want] and all(math.isclose(a, b) for (a, _), (b, _) in zip(got, want, strict=True))


def test_equal_amounts(spark):
    rows = [(1, "net_contents", "750 ml", "0.75 L"), (2, "net_contents", "750 ml", "750 millilitres"), (3, "net_contents", "1,057 pints", "500 ml"), (4, "alcohol_content", "80 proof", "40%"), (5, "alcohol_content", "80", "40%"), (6, "net_contents", None, "1 l"), (7, "net_contents", "", ""), (8, "alcohol_content", "40%", "40 proof"), (9, "brand_name", "750 ml", "0.75 L"), (4, "alcohol_content", "80 proof", "40%")]
    df = spark.createDataFrame(rows, "finding_id bigint, field_name string, extracted_value string, expected_value string").withColumn("solved", F.lit("clash"))
    assert sorted(r.finding_id for r in equal_amounts(df).collect()) == [1, 3, 4, 4]
    assert equal_amounts(df.limit(0)).count() == 0
    assert finding_readings(df).count() == 9


def test_identity_of_three_columns(spark):
    """mass = density * volume finds the units, and flags what two combinations solve."""
    df = spark.createDataFrame([(1, 0.75, 1.0, 750.0), (2, None, 1.0, 2.0), (3, 0.0, 1.0, 2.0)], "id int, mass double, density double, volume double")
    df = df.select("id", unit_options(F.col("mass"), {"g": 1.0, "kg": 1000.0}).alias("mass"), unit_options(F.col("density"), {"g/ml": 1.0}).alias("density"), unit_options(F.col("volume"), {"ml": 1.0, "l": 1000.0}).alias("volume"))
    got = {r.id: r.solved for r in solve_identity(df, {"mass": 1, "density": -1, "volume": -1}).collect()}
    assert got[1].units == ["kg", "g/ml", "ml"] and got[1].fits and got[1].unique
    assert got[2] is None and got[3] is None
    twice = solve_identity(df.select("id", F.expr("array(named_struct('amount', 1d, 'unit', 'a'), named_struct('amount', 1d, 'unit', 'b'))").alias("x"), F.expr("array(named_struct('amount', 1d, 'unit', 'c'))").alias("y")), {"x": 1, "y": -1}).first().solved
    assert twice.fits and not twice.unique and twice.units == ["a", "c"]
    assert set(ABV) == {"percent", "proof", "ml/l", "fraction"}


@pytest.mark.parametrize(("text", "want"), [
    ("1 L 500 mL", (1500.0, "l")), ("1 litre and 25 cl", (1250.0, "l")), ("75 cl 5 ml", (755.0, "cl")), ("1 PT 16.0 fl. oz.", (2 * ML["pint"], "pint")), ("1 gal 1 qt", (ML["gallon"] + ML["quart"], "gallon")), ("75 cl, 750 ml", (750.0, "cl")), ("0.75 L 750 mL", (750.0, "l")), ("1 L, 33.8 fl oz", (1000.0, "l")),
    ("Net.750 mL", (750.0, "ml")), ("Net .75 L", (750.0, "l")), ("CONT.1.5 L", (1500.0, "l")),
])
def test_second_part_and_point_after_a_letter(text, want):
    amount, unit = read_volume(text)[0]
    assert unit == want[1] and math.isclose(amount, want[0])


@pytest.mark.parametrize(("text", "want"), [("Alc.40% vol", (40.0, "percent")), ("Alc. .5% vol", (0.5, "percent")), ("Proof.80", (40.0, "proof")), ("vol.fraction.4", (40.0, "fraction"))])
def test_alcohol_after_a_point(text, want):
    assert read_alcohol(text) == [want]


def test_compound_metric_amount_is_equal(spark):
    df = spark.createDataFrame([(1, "net_contents", "1 L 500 mL", "150 cl"), (2, "net_contents", "1 L 500 mL", "1000 ml"), (3, "alcohol_content", "Alc.40% vol", "80 proof")], "finding_id bigint, field_name string, extracted_value string, expected_value string")
    assert sorted(r.finding_id for r in equal_amounts(df).collect()) == [1, 3]


def test_all_amounts_and_units_are_readings():
    assert [u for _, u in read_volume("1 L, 33.8 fl oz")] == ["l", "floz"] and [u for _, u in read_alcohol("80 proof (40% vol)")] == ["proof", "percent"]
    assert read_bare("0.75", {"ml": 1.0, "l": 1000.0}) == [(0.75, "?ml"), (750.0, "?l")] and read_bare("see label 7", {"ml": 1.0}) == [] == read_bare("", {"ml": 1.0})


def test_the_solver_decides(spark):
    """What the first reading alone would give differs in every row."""
    rows = [(1, "net_contents", "1,057 pints", "500 ml"), (2, "net_contents", "1 case, 75 cl (25.36 fl oz)", "25.36 fluid ounces"), (3, "alcohol_content", "5% off! 80 proof", "40 % vol"), (4, "net_contents", "12 fl oz pack, 750 ml each", "75 cl"), (5, "net_contents", "0.75", "750 ml")]
    df = spark.createDataFrame(rows, "finding_id bigint, field_name string, extracted_value string, expected_value string")
    assert sorted(r.finding_id for r in equal_amounts(df).collect()) == [1, 3, 4]
    first = lambda c: F.slice(c, 1, 1).alias(c)
    only = solve_identity(finding_readings(df).select("finding_id", first("extracted_readings"), first("expected_readings")), {"extracted_readings": 1, "expected_readings": -1})
    assert {r.finding_id for r in only.filter("solved.fits").collect()} <= {2}
    s = {r.finding_id: r.solved for r in solve_identity(finding_readings(df), {"extracted_readings": 1, "expected_readings": -1}).collect()}
    assert s[5].units == ["?l", "ml"] and s[5].fits and s[5].unique and s[2].units == ["floz", "floz"] and not s[2].unique
