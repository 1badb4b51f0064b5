"""Verdicts: bands, rule dispositions, confidence floor, lean; aggregates over fields and labels; overrides; headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayist.functions.text import uncertain_code

PASS, FAIL, REVIEW = "pass", "fail", "needs_review"


def band(confidence: Column) -> Column:
    """low, medium, high; a confidence outside [0, 1] is an error."""
    return F.when(confidence.isNull(), F.lit(None)).when((confidence < 0) | (confidence > 1), F.raise_error(F.lit("confidence outside [0, 1]"))).when(confidence < 0.5, "low").when(confidence < 0.85, "medium").otherwise("high")


def rule_disposition(outcome: Column, severity: Column) -> Column:
    """An error or a timeout is never a failure, and a warning can only ask for review."""
    return F.when(outcome == "PASS", PASS).when(outcome == "NOT_APPLICABLE", "not_applicable").when((outcome == "FAIL") & (severity != "warn"), FAIL).otherwise(REVIEW)


def with_floor(results: DataFrame) -> DataFrame:
    """Rejections read with less than the floor's confidence become uncertain: outcome, severity, reason_code, lean.

    Columns: outcome, severity, reason_code, lean, confidence, floor, has_evidence, exempt.
    """
    low = (F.col("outcome") == "FAIL") & (F.col("severity") == "reject") & F.col("has_evidence") & (F.col("confidence") < F.col("floor")) & ~F.coalesce(F.col("exempt"), F.lit(False))
    new = {"outcome": F.lit("INSUFFICIENT"), "severity": F.lit("warn"), "reason_code": uncertain_code(F.col("reason_code")), "lean": F.when(F.col("confidence") > 0.5, FAIL).otherwise(F.lit(PASS))}
    return results.select(*(F.when(low, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in results.columns))


def lean(disposition: Column, own: Column, registered: Column) -> Column:
    return F.when(disposition == REVIEW, F.coalesce(own, registered, F.lit(FAIL)))


def lattice(disposition: Column) -> Column:
    """Aggregate: any fail fails; all pass or not applicable pass; none at all, or anything else, needs review."""
    like = disposition.isin(PASS, "not_applicable")
    return F.when(F.count(disposition) == 0, REVIEW).when(F.bool_or(disposition == FAIL), FAIL).when(F.bool_and(F.coalesce(like, F.lit(False))), PASS).otherwise(REVIEW)


def worst(disposition: Column) -> Column:
    rank = F.max(F.when(disposition == FAIL, 3).when(disposition == REVIEW, 2).when(disposition == PASS, 1).otherwise(0))
    return F.when(rank == 3, FAIL).when(rank == 2, REVIEW).when(rank == 1, PASS).otherwise(F.lit("not_applicable"))


def last_by(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last value of each key; ties are broken by the further columns of ``order``."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(out))


def corrected(verdicts: DataFrame, overrides: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``verdicts`` (keys, disposition) with the last override of each key (keys, applied, order...) in its place."""
    last = last_by(overrides, keys, order, "applied", "_applied")
    return verdicts.join(last, keys, "left").select(*(F.coalesce(F.col("_applied"), F.col("disposition")).alias("disposition") if c == "disposition" else F.col(c) for c in verdicts.columns), F.col("_applied").isNotNull().alias("overridden"))


def headline(findings: DataFrame, keys: list[str], disposition: str, code: str, position: str) -> DataFrame:
    """The code to show: that of the first finding that isn't a pass, else of the first finding."""
    tier = F.when(F.col(disposition) == PASS, 1).otherwise(0)
    return findings.groupBy(*keys).agg(F.min_by(code, F.struct(tier, F.col(position))).alias("headline_code"))


def deciding(findings: DataFrame, keys: list[str], disposition: str, explained: Column, position: str) -> DataFrame:
    """The finding that decides: fail before review before pass, one with an explanation first, then by position."""
    rank = F.when(F.col(disposition) == FAIL, 0).when(F.col(disposition) == REVIEW, 1).otherwise(2)
    rest = [c for c in findings.columns if c not in keys]
    order = F.struct(rank, F.when(explained, 0).otherwise(1), F.col(position))
    return findings.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best")).select(*keys, "_best.*").select(*findings.columns)


def scoreboard(labels: DataFrame, disposition: str) -> DataFrame:
    """Counts by disposition and the share that is clear (pass or fail)."""
    return labels.agg(F.count("*").alias("n"), *(F.count_if(F.col(disposition) == d).alias(f"n_{d}") for d in (PASS, FAIL, REVIEW)), F.bround(F.count_if(F.col(disposition).isin(PASS, FAIL)) / F.nullif(F.count("*"), F.lit(0)), 3).alias("clear_share"))


def causes(findings: DataFrame, code: str, position: str) -> DataFrame:
    """Codes by frequency, ties by first appearance."""
    return findings.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n"), F.min(position).alias("first_at")).orderBy(F.desc("n"), "first_at")
