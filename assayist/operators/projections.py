"""Projections of observations, declared records and audit rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reading_text(parts: list[Column], separator: str = ", ") -> Column:
    """One string of the parts that are stated: null and blank ones are left out; empty if none is."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), separator)


def display_number(x: Column) -> Column:
    """A number as it would be printed: no trailing zeros, no point at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"0+$", ""), r"\.$", "")


def display_amount(amount: Column, unit: Column) -> Column:
    return F.when(amount.isNotNull(), F.trim(F.concat_ws(" ", display_number(amount), unit)))


def display_reading(field: Column, text: Column, printed: Column, amount: Column, unit: Column, heading: Column) -> Column:
    """A reading as the card shows it: the printed statement before the figure, amounts with their unit, the heading before a text that doesn't hold it."""
    stated = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    headed = F.when(stated(heading).isNotNull() & ~F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(heading)), F.concat_ws(" ", stated(heading), stated(text))).otherwise(text)
    return F.coalesce(F.when(field == "alcohol", F.coalesce(stated(printed), display_amount(amount, unit))).when(field == "contents", display_amount(amount, unit)).when(field == "warning", headed), stated(text), F.lit(""))


def unreadable(fields: Column) -> Column:
    """Whether a face has nothing but the word of the quality gate: one observation, of the field ``quality``."""
    return (F.size(fields) == 1) & (F.get(fields, F.lit(0)) == "quality")


def slot(field: Column, slots: dict[str, str]) -> Column:
    """The output slot of a field, null for a field without one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in slots.items() for x in kv)), field) if slots else F.lit(None).cast("string")


def form_record(df: DataFrame, fields: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Declared fields of a form: blank becomes null; ``fault`` says why a record can't be taken."""
    clean = [F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in fields]
    rest = [F.col(c) for c in df.columns if c not in fields and c != "fault"]
    df = df.select(*rest, *clean)
    stated = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in fields if c != kind], F.lit(False))
    return df.withColumn("fault", F.when(F.col(kind).isNull() & stated, "no type").when(~F.col(kind).isin(kinds), "unknown type"))


def text_as_written(source: Column, words: Column) -> Column:
    """The stretch of ``source`` that spells ``words`` (array, lower case), whatever stands between them; null if there is none."""
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])("), F.array_join(quoted, r"[^\p{L}\p{N}]+"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(words) > 0, F.nullif(F.call_function("regexp_extract", source, pattern, F.lit(1)), F.lit("")))


def trace(results: DataFrame, keys: list[str]) -> DataFrame:
    """Audit rows (keys, trace_id, disposition, evidence_ref): one for each result, and one for the code of each that isn't a pass."""
    row = F.struct(F.concat(F.lit("vr/"), F.col("rule_id")).alias("trace_id"), F.col("disposition"), F.lit(None).cast("string").alias("evidence_ref"))
    code = F.when((F.col("disposition") != "pass") & F.col("reason_code").isNotNull(), F.struct(F.concat(F.lit("rc/"), F.col("rule_id")).alias("trace_id"), F.col("disposition"), F.concat(F.lit("reason_code/"), F.col("reason_code")).alias("evidence_ref")))
    return results.select(*keys, F.explode(F.filter(F.array(row, code), lambda x: x.isNotNull())).alias("t")).select(*keys, "t.*")


def photo_needed(findings: Column, traced: Column, codes: list[str]) -> Column:
    """The first code that asks for a better photograph: among the findings, else in the trace."""
    known = F.array(*map(F.lit, codes))
    first = lambda a: F.get(F.filter(a, lambda c: F.array_contains(known, c)), F.lit(0))
    return F.coalesce(first(findings), first(traced))


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """A seeded sample of ``n`` rows, the same however the rows are spread."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
