"""Result cards: results, observations and expected values joined by slot; corrections by a reviewer; the audit trace.

All tables are keyed by ``label``. Cards are built by aggregates (a hot label is combined map-side), corrections by semi
and anti joins on (label, rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayist.operators import verdict
from assayist.session import small

REF = "reason_code/"


def _first(df: DataFrame, slots: DataFrame, value: Column, name: str) -> DataFrame:
    """The value of each (label, slot): that of the slot's first field id which the label has."""
    return df.join(small(slots), "field").groupBy("label", "slot").agg(F.min_by(value, "rank").alias(name))


def cards(results: DataFrame, observations: DataFrame, expected: DataFrame, slots: DataFrame) -> DataFrame:
    """One card for each (label, slot) of which something was observed.

    ``results``: label, rule_id, field, outcome, severity, code, lean, confidence; ``observations``: label, field, value,
    confidence (null without evidence); ``expected``: label, field, value; ``slots``: field, slot, rank. Gives slot, observed,
    expected, findings (array of rule_id, disposition, code, lean, by rank and rule), disposition (worst), confidence (the
    least of the rules that applied, else the observation's), lean (fail if any finding leans so; null without findings).
    A slot that is only expected has no card; results without a field are left to the trace.
    """
    own = F.struct(F.col("value").alias("observed"), F.col("confidence").alias("seen"))
    seen = _first(observations, slots, own, "o").filter("o.seen is not null")
    want = _first(expected, slots, F.col("value"), "expected")
    rated = results.join(small(slots), "field").withColumn("disposition", verdict.rule_disposition(F.col("outcome"), F.col("severity"))).filter("disposition <> 'not_applicable'")
    row = F.struct("rank", "rule_id", "disposition", "code", "lean")
    found = rated.groupBy("label", "slot").agg(F.array_sort(F.collect_list(row)).alias("f"), F.min("confidence").alias("least"), verdict.worst(F.col("disposition")).alias("disposition"))
    out = seen.join(want, ["label", "slot"], "left").join(found, ["label", "slot"], "left")
    findings = F.transform(F.coalesce("f", F.array().cast("array<struct<rank:int,rule_id:string,disposition:string,code:string,lean:string>>")), lambda x: F.struct(x.rule_id.alias("rule_id"), x.disposition.alias("disposition"), x.code.alias("code"), x.lean.alias("lean")))
    lean = F.when(F.col("f").isNotNull(), F.when(F.exists("f", lambda x: F.coalesce(x.lean == "fail", F.lit(False))), "fail").otherwise("pass"))
    return out.select("label", "slot", F.col("o.observed").alias("observed"), "expected", findings.alias("findings"), "disposition", F.coalesce("least", "o.seen").alias("confidence"), lean.alias("lean"))


def last_corrections(overrides: DataFrame) -> DataFrame:
    """The last correction of each (label, slot): label, slot (null for the whole label), applied, seq."""
    return overrides.groupBy("label", "slot").agg(F.max_by("applied", "seq").alias("applied"), F.max("seq").alias("seq"))


def corrected_cards(shown: DataFrame, overrides: DataFrame) -> DataFrame:
    """Cards with the last correction in place: disposition and lean (a review keeps the check's own lean)."""
    last = last_corrections(overrides).filter("slot is not null").select("label", "slot", "applied")
    now = F.coalesce("applied", "disposition")
    lean = F.when(F.col("applied").isin("pass", "fail"), F.col("applied")).otherwise(F.col("lean"))
    return shown.join(last, ["label", "slot"], "left").select(*(now.alias(c) if c == "disposition" else lean.alias(c) if c == "lean" else F.col(c) for c in shown.columns))


def _rule_of(ref: Column) -> Column:
    return F.regexp_replace(ref, f"^{REF}", "")


def _off_cards(trace: DataFrame, rules: DataFrame) -> DataFrame:
    """Trace rows whose rule is not among ``rules`` (label, rule_id), by name or by reference."""
    other = rules.select("label", F.col("rule_id").alias("_ref")).distinct()
    rest = trace.join(rules.select("label", "rule_id").distinct(), ["label", "rule_id"], "left_anti")
    return rest.withColumn("_ref", _rule_of(F.coalesce("evidence_ref", F.lit("")))).join(other, ["label", "_ref"], "left_anti").drop("_ref")


def corrected_trace(trace: DataFrame, shown: DataFrame, overrides: DataFrame) -> DataFrame:
    """(label, disposition) verdicts that count: the rows of no corrected card, and the corrections in place of the others."""
    last = last_corrections(overrides).filter("slot is not null")
    gone = shown.join(last.select("label", "slot"), ["label", "slot"], "left_semi").select("label", F.explode("findings.rule_id").alias("rule_id"))
    return _off_cards(trace, gone).select("label", "disposition").unionByName(last.select("label", F.col("applied").alias("disposition")))


def corrected_labels(labels: DataFrame, trace: DataFrame, shown: DataFrame, overrides: DataFrame) -> DataFrame:
    """Labels (label, disposition) after corrections: those of cards replace their rules' verdicts; one of the whole label is a further verdict, which can hold a label back but not lift it."""
    last = last_corrections(overrides)
    touched = last.filter("slot is not null").select("label").distinct()
    anew = corrected_trace(trace, shown, overrides).join(touched, "label", "left_semi").groupBy("label").agg(verdict.lattice(F.col("disposition")).alias("anew"))
    whole = last.filter("slot is null").select("label", F.col("applied").alias("whole"))
    both = labels.join(anew, "label", "left").join(whole, "label", "left").withColumn("own", F.coalesce("anew", "disposition"))
    fail = (F.col("own") == "fail") | (F.col("whole") == "fail")
    fine = F.col("own").isin("pass", "not_applicable") & F.col("whole").isin("pass", "not_applicable")
    return both.select("label", F.when(F.col("whole").isNull(), F.col("own")).when(fail, "fail").when(fine, "pass").otherwise("needs_review").alias("disposition"))


def label_leans(labels: DataFrame, trace: DataFrame, shown: DataFrame) -> DataFrame:
    """(label, lean): a settled label is its own answer; else fail if a card leans so, or if a row of no card asks for review."""
    on = shown.select("label", F.explode("findings.rule_id").alias("rule_id"))
    orphan = _off_cards(trace.filter("disposition = 'needs_review'"), on).select("label").distinct().withColumn("orphan", F.lit(True))
    leans = shown.groupBy("label").agg(F.bool_or(F.coalesce(F.col("lean") == "fail", F.lit(False))).alias("fails"))
    both = labels.join(leans, "label", "left").join(orphan, "label", "left")
    bad = F.coalesce("fails", F.lit(False)) | F.coalesce("orphan", F.lit(False))
    return both.select("label", F.when(F.col("disposition") != "needs_review", F.col("disposition")).when(bad, "fail").otherwise("pass").alias("lean"))


def accepted(overrides: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) corrections: those whose code the registry (code) has, and the others."""
    codes = small(registry.select("code").distinct())
    return overrides.join(codes, "code", "left_semi"), overrides.join(codes, "code", "left_anti")


def traced_outcomes(trace: DataFrame) -> DataFrame:
    """(label, rule_id, disposition, code) of the rows of rules, with the code that a row of references gives for the rule."""
    ref = F.coalesce("evidence_ref", F.lit(""))
    codes = trace.filter(ref.startswith(REF)).groupBy("label", _rule_of(ref).alias("rule_id")).agg(F.max("rule_id").alias("code"))
    return trace.filter(ref.startswith("vr/")).select("label", "rule_id", "disposition").join(codes, ["label", "rule_id"], "left")


def code_faults(outcomes: DataFrame, registry: DataFrame) -> DataFrame:
    """Outcomes (label, rule_id, disposition, code) whose code contradicts them: a fail needs a code of severity reject, a review one of warn. ``registry``: code, severity."""
    want = F.when(F.col("disposition") == "fail", "reject").when(F.col("disposition") == "needs_review", "warn")
    both = outcomes.withColumn("want", want).filter("want is not null").join(small(registry.select("code", "severity")), "code", "left")
    fault = F.when(F.coalesce("code", F.lit("")) == "", "no code").when(F.col("severity").isNull(), "unknown code").when(F.col("severity") != F.col("want"), F.concat(F.lit("a code of "), F.col("severity")))
    return both.withColumn("fault", fault).filter("fault is not null").select("label", "rule_id", "disposition", "code", "fault")


def unregistered(emitted: DataFrame, registry: DataFrame) -> DataFrame:
    """Codes on one side only: (code, side), side ``emitted`` or ``registered``."""
    a, b = emitted.select("code").filter("code is not null").distinct(), registry.select("code").distinct()
    return a.join(b, "code", "left_anti").withColumn("side", F.lit("emitted")).unionByName(b.join(a, "code", "left_anti").withColumn("side", F.lit("registered")))


def retagged(observations: DataFrame, records: DataFrame) -> DataFrame:
    """Observations with the class of their label's record; without one no observation reaches the rules. ``records``: label, class."""
    return observations.drop("class").join(records.filter("class is not null").select("label", "class"), "label")


def gathered(observations: DataFrame, field: str, items: str, distinct: bool) -> DataFrame:
    """(label, items): the lists that all faces give for a field, in the order of the faces; each item once if ``distinct``. Null if no face has a list.

    ``observations``: label, field, face_position and the list column ``items``.
    """
    rows = observations.filter((F.col("field") == field) & F.col(items).isNotNull())
    lists = F.array_sort(F.collect_list(F.struct("face_position", F.col(items).alias("x"))))
    flat = F.flatten(F.transform(lists, lambda s: s.x))
    return rows.groupBy("label").agg((F.array_distinct(flat) if distinct else flat).alias(items))


def with_failures(trace: DataFrame, failures: DataFrame) -> DataFrame:
    """The trace with a row that needs review for each failure (label, rule_id) of the engine."""
    return trace.unionByName(failures.select("label", "rule_id", F.lit("needs_review").alias("disposition"), F.lit("engine").alias("evidence_ref")))


def first_failure(trace: DataFrame, prefix: str) -> DataFrame:
    """(label, rule_id) of the first row by ``position`` that stands for a failure of the engine: the check stopped early."""
    return trace.filter(F.col("rule_id").startswith(prefix)).groupBy("label").agg(F.min_by("rule_id", "position").alias("rule_id"))


def by_disposition(rows: DataFrame, descending: bool = False) -> DataFrame:
    """Rows of a batch in the order pass, review, fail (or back), then by position; adds ``rank``."""
    rank = F.when(F.col("disposition") == "pass", 0).when(F.col("disposition") == "needs_review", 1).otherwise(2)
    return rows.withColumn("rank", rank).orderBy(F.desc("rank") if descending else F.asc("rank"), "position")


def result_order(results: DataFrame) -> DataFrame:
    """Results with their ``place`` in the label: by rule, then by field."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("rule_id", "field")))


def to_confirm(shown: DataFrame, overrides: DataFrame) -> DataFrame:
    """(label, confirm): whether a card that needs review has no correction yet."""
    last = last_corrections(overrides).filter("slot is not null").select("label", "slot", F.lit(True).alias("done"))
    open_ = (F.col("disposition") == "needs_review") & F.col("done").isNull()
    return shown.join(last, ["label", "slot"], "left").groupBy("label").agg(F.bool_or(open_).alias("confirm"))


def current(evaluations: DataFrame, running: DataFrame, stored: DataFrame) -> DataFrame:
    """(evaluation, disposition, origin) of each evaluation: that of a running batch, else the stored one; neither gives nulls."""
    r, s = running.select("evaluation", F.col("disposition").alias("r")), stored.select("evaluation", F.col("disposition").alias("s"))
    both = evaluations.select("evaluation").distinct().join(r, "evaluation", "left").join(s, "evaluation", "left")
    return both.select("evaluation", F.coalesce("r", "s").alias("disposition"), F.when(F.col("r").isNotNull(), "running").when(F.col("s").isNotNull(), "stored").alias("origin"))
