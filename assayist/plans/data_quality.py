"""Queries of the general data problems: quantities in several units, messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayist.operators.delivery import deliver_once, repeated_deliveries
from assayist.operators.quantities import equal_amounts, finding_readings, solve_identity
from assayist.plans import amounts
from assayist.session import read_table

_FINDING = ["finding_id", "field_name", "extracted_value", "expected_value"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_amounts(read_table(spark, sf_dir, "field_finding").select(_FINDING)).select("finding_id")


def p2_common_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both values of every alcohol and volume finding in common units, with the solver's verdict.

    A unit that no text states ("?" before it) is taken only where the other side's amount singles it out.
    """
    rows = finding_readings(read_table(spark, sf_dir, "field_finding").select(_FINDING))
    s = solve_identity(rows, {"extracted_readings": 1, "expected_readings": -1})
    found, fits = F.col("solved"), F.col("solved.fits")

    def side(name: str, i: int) -> list[Column]:
        own = F.get(F.col(f"{name}_readings"), F.lit(0))
        pick = F.when(found.isNotNull(), F.struct(F.get(found.amounts, F.lit(i)).alias("amount"), F.get(found.units, F.lit(i)).alias("unit"))).otherwise(own)
        sure = ~pick.unit.startswith("?") | (F.coalesce(fits, F.lit(False)) & found.unique)
        return [F.when(sure, F.round(pick.amount, 6)).alias(f"{name}_amount"), F.when(sure, pick.unit).alias(f"{name}_unit")]

    return s.select("finding_id", "field_name", *side("extracted", 0), *side("expected", 1), fits.alias("fits"), found.unique.alias("unique_solution"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "batch_message")
    return repeated_deliveries(rows, "evaluation_id", "delivered_at", "delivery_id").select("delivery_id")


def p4_delivered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "batch_message").select("delivery_id", "evaluation_id", "batch_id", "queue_position", "label_ref", "disposition", "delivered_at")
    return deliver_once(rows, "evaluation_id", "delivered_at", "delivery_id").select("delivery_id", "evaluation_id", "batch_id", "queue_position", "label_ref", "disposition")


QUERIES = {"p2_found": p2_found, "p2_common_units": p2_common_units, "p4_found": p4_found, "p4_delivered_once": p4_delivered_once}

_KEY = "replace(regexp_replace(regexp_replace(lower(trim(evaluation_id)), '^urn:uuid:', ''), '[{}]', '', 'g'), '-', '')"
_RANKED = f"SELECT *, {_KEY} AS k, row_number() OVER (PARTITION BY {_KEY} ORDER BY delivered_at NULLS LAST, delivery_id) AS rn FROM batch_message"
ORACLE = {
    "p2_found": amounts.p2_found(),
    "p4_found": f"SELECT delivery_id FROM ({_RANKED}) WHERE k <> '' AND rn > 1",
    "p4_delivered_once": f"SELECT delivery_id, evaluation_id, batch_id, queue_position, label_ref, disposition FROM ({_RANKED}) WHERE k IS NULL OR k = '' OR rn = 1",
}
