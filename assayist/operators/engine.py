"""The rule-driven join: rules to observations, observations to expected values, results to reason codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayist.operators import validators
from assayist.session import small


def applicable(obs: DataFrame, rules: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Enabled rules with the observations they apply to, each pair once.

    ``obs``: obs_id, field, class, ...; ``rules``: rule_id, classes array, evidence array, disabled. A rule without evidence
    applies to every observation of its classes. ``obs_id`` is unique. The join is on the class; the names are looked up in
    the row, so nothing is shuffled to drop repeats.
    """
    names = F.array(F.col("field"))
    for k, v in (aliases or {}).items():
        names = F.when(F.col("field") == k, F.array(*map(F.lit, [k, *v]))).otherwise(names)
    live = rules.filter(~F.coalesce(F.col("disabled"), F.lit(False)))
    one = live.select("rule_id", F.explode("classes").alias("class"), F.explode_outer("evidence").alias("name")).distinct()
    # the rules of a (class, name) are gathered, so that a pair met under several names is made once, within its row
    sets = one.groupBy("class", "name").agg(F.collect_set("rule_id").alias("_r"))
    all_ = sets.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("name", F.lit("")).alias("name"), "_r"))).alias("_by"))
    of = lambda n: F.coalesce(F.try_element_at("_by", n), F.array().cast("array<string>"))
    met = obs.join(small(all_), "class")
    rules_of = F.array_distinct(F.flatten(F.transform(F.array_append(names, F.lit("")), of)))
    return met.select(*obs.columns, F.explode(rules_of).alias("rule_id"))


def expected_of(obs: DataFrame, expected: DataFrame, keys: list[str], aliases: DataFrame) -> DataFrame:
    """Left join to the expected value under the field's own name, else under its aliases in order; the first wins.

    ``expected``: keys, field, value; ``aliases``: field, alias, priority (own name has priority 0).
    """
    own = obs.select(*obs.columns, F.col("field").alias("_want"), F.lit(0).alias("_p"))
    other = obs.join(small(aliases.select("field", F.col("alias").alias("_want"), F.col("priority").alias("_p"))), "field").select(own.columns)
    right = expected.select(*keys, F.col("field").alias("_want"), F.col("value").alias("expected_value"))
    both = own.unionByName(other).join(right, [*keys, "_want"], "left").filter("expected_value is not null or _p = 0")
    best = F.min_by("expected_value", F.when(F.col("expected_value").isNotNull(), F.col("_p")))
    return both.groupBy(*obs.columns).agg(best.alias("expected_value"))


def checked(df: DataFrame, rules: list[dict], inputs, code: str = "result") -> DataFrame:
    """Evaluate each rule over the rows of its field: one row for each (row, rule), as a single pass over ``df``.

    ``rules``: rule_id, field, validator, severity, floor, parameters; ``inputs(rule)`` gives the validator's columns.
    """
    out = F.array(*(F.when(F.col("field_name") == r["field"], F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), F.lit(float(r.get("floor", 0.5))).alias("floor"), validators.run(r["validator"], inputs(r)).alias(code))) for r in rules))
    return df.select("*", F.explode(F.filter(out, lambda x: x.isNotNull())).alias("_r")).select(*df.columns, "_r.rule_id", "_r.severity", "_r.floor", f"_r.{code}.*")


def explained(results: DataFrame, registry: DataFrame, code: str, message: Column) -> DataFrame:
    """Results with a message: their own, else the registry's description, else none."""
    return results.join(small(registry.select(F.col("code").alias(code), "description", F.col("lean").alias("registered_lean"))), code, "left").withColumn("explanation", F.coalesce(message, F.col("description")))
