from pyspark.sql import functions as F

from assayist.functions.marks import proofs
from assayist.operators import projections as P


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = lambda x: F.lit(x).cast("string")
    assert one(P.reading_text([lit("a"), lit(None), lit("  "), lit("b")])) == "a, b" and one(P.reading_text([lit(None)])) == ""
    assert [one(P.display_amount(F.lit(x).cast("double"), lit(u))) for x, u in ((750.0, "mL"), (12.5, "%"), (None, "mL"), (40.0, None))] == ["750 mL", "12.5 %", None, "40"]
    assert one(proofs(lit("90 Proof, 90 PROOF or 45.5° proof; 80-90 proof; 1290 proof"))) == ["90", "90", "45.5"]
    assert one(P.text_as_written(lit("By the OLD—Mill, Co."), F.array(F.lit("old"), F.lit("mill")))) == "OLD—Mill"
    assert one(P.text_as_written(lit("gold mill"), F.array(F.lit("old"), F.lit("mill")))) is None
    codes = lambda *x: F.array(*map(F.lit, x))
    assert one(P.photo_needed(codes("A", "BLUR"), codes("DARK"), ["BLUR", "DARK"])) == "BLUR" and one(P.photo_needed(codes("A"), codes("DARK"), ["BLUR", "DARK"])) == "DARK"


def test_sample_is_seeded(spark):
    df = spark.range(100)
    a, b = ({r.id for r in P.sample(df.repartition(n), 7, 3, "id").collect()} for n in (1, 5))
    assert a == b and len(a) == 7 and P.sample(df.limit(0), 7, 3, "id").count() == 0
