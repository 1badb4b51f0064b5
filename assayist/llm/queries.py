"""Queries of the operators for large training data, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayist.llm import addresses, canonical, dyadic, leakage, mixing, sql, subjects, transducer
from assayist.session import read_table, spread, written

_FINDING = ["finding_id", "field_name", "extracted_value", "expected_value"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "field_finding").select("finding_id", "extracted_value", "expected_value")
    return transducer.visibly_same(rows, "extracted_value", "expected_value").select("finding_id")


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both values of every finding in the consistent form."""
    v = transducer.visible
    return read_table(spark, sf_dir, "field_finding").select("finding_id", v(F.col("extracted_value")).alias("extracted_form"), v(F.col("expected_value")).alias("expected_form"))


_GROUP = ["model_version", "week_start", "cache_hit", "metric_name"]


def p3_found(spark: SparkSession, sf_dir: str, limit: int = 5000, least: int = 40) -> DataFrame:
    """Sketches of days, merged to weeks, decide; groups within the rank's error of the limit are counted exactly."""
    values = dyadic.unpivoted(read_table(spark, sf_dir, "metrics"))
    counts = written(dyadic.coded(values, _GROUP, "day", "value", at_most=F.when(F.col("value") <= limit, 1).otherwise(0)), "codes")
    return dyadic.above(counts, _GROUP, "day", [50, 90], limit, least, "at_most")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of every group from the merged sketches of its days, with the bound of the rank's error."""
    counts = dyadic.coded(dyadic.unpivoted(read_table(spark, sf_dir, "metrics")), _GROUP, "day", "value")
    return dyadic.merged(dyadic.sketches(counts, [*_GROUP, "day"]), _GROUP, [50, 90, 99]).drop("n_least", "n_most")


def p3_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact rank of each sketched percentile lies within the bound that comes with it."""
    counts = written(dyadic.coded(dyadic.unpivoted(read_table(spark, sf_dir, "metrics")), _GROUP, "day", "value"), "codes")
    sketched = dyadic.merged(dyadic.sketches(counts, [*_GROUP, "day"]), _GROUP, [50, 90, 99]).withColumn("code", dyadic.Shape().encode(F.col("value")))
    codes = counts.groupBy(*_GROUP, F.col("code").alias("c")).agg(F.sum("n").alias("m"))
    ranks = sketched.join(codes, _GROUP).groupBy(*_GROUP, "pct", "n", "code", "rank_error").agg(F.sum(F.when(F.col("c") < F.col("code"), F.col("m")).otherwise(0)).alias("below"), F.sum(F.when(F.col("c") <= F.col("code"), F.col("m")).otherwise(0)).alias("upto"))
    need = F.ceil(F.col("pct") * F.col("n") / F.lit(100))
    return ranks.select(*_GROUP, "pct", "n", ((F.col("below") - F.col("rank_error") < need) & (F.col("upto") + F.col("rank_error") >= need)).alias("within"))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "application").select("application_id", "street", "city", "state", "zip")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.same_place(_addresses(spark, sf_dir), "application_id").select(F.col("id_a").alias("application_id_a"), F.col("id_b").alias("application_id_b"))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each application with a place: its record (the smallest application of equal components) and that record's links to other records."""
    members, links = addresses.places(_addresses(spark, sf_dir), "application_id")
    ends = links.select(F.explode(F.array("record_a", "record_b")).alias("record")).groupBy("record").agg(F.count("*").alias("n_links"))
    return members.join(ends, "record", "left").select(F.col("id").alias("application_id"), "record", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that denote the same place, with the estimated probability."""
    _, links = addresses.places(_addresses(spark, sf_dir), "application_id")
    return links.select("record_a", "record_b", F.round("probability", 6).alias("probability"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonicalized(read_table(spark, sf_dir, "field_finding").select(_FINDING), read_table(spark, sf_dir, "canonical_entry"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and items with a passage of twelve words and at most one error in it."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leakage.leaks(docs, read_table(spark, sf_dir, "eval_item"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).filter("errors = 0 and exact_words >= 12").select("doc_id", "item_id")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.mixed(docs, read_table(spark, sf_dir, "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, sf_dir), read_table(spark, sf_dir, "mix_target"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target, whether its share of the mix is met (within 0.002 and four documents of it, among the sources that have documents) and no document of it is used too often."""
    targets = read_table(spark, sf_dir, "mix_target")
    got = mixing.shares(mixed := written(p8_mix(spark, sf_dir), "mix"), targets).join(targets.select(mixing.source_name(F.col("source")).alias("source"), "max_repeats"), "source")
    held = mixed.select("source").distinct().join(targets.select(mixing.source_name(F.col("source")).alias("source"), "target_share"), "source").agg(F.sum("target_share").alias("held"))
    size = mixed.agg((F.lit(4) * F.max("tokens") / F.sum(F.col("times") * F.col("tokens"))).alias("some"))
    met = F.when(F.col("n_documents") > 0, F.abs(F.col("actual_share") - F.col("target_share") / F.col("held")) <= 0.002 + F.col("some")).otherwise(F.col("tokens") == 0)
    return got.join(F.broadcast(held)).join(F.broadcast(size)).select("source", met.alias("share_met"), (F.col("most_used") <= F.col("max_repeats")).alias("repeats_kept"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = read_table(spark, sf_dir, "canonical_entry").filter("field_name = 'brand_name'").select("canonical_name")
    quoted = read_table(spark, sf_dir, "eval_item").select("item_text")
    return subjects.subjects(docs, read_table(spark, sf_dir, "subject_label"), read_table(spark, sf_dir, "subject_area"), quoted, names)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject_id")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents that keep a subject, and their sentences about it."""
    return _subjects(spark, sf_dir).groupBy("subject_id").agg(F.count("*").alias("n_documents"), F.sum("n_about").alias("n_sentences"))


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms, "p3_found": p3_found, "p3_percentiles": p3_percentiles, "p3_within_bound": p3_within_bound, "p5_found": p5_found, "p5_records": p5_records, "p5_links": p5_links, "p6_found": p6_found, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_kept": p8_kept, "p9_found": p9_found, "p9_composition": p9_composition}

_ONCE = "SELECT any_value(model_version) AS model_version, any_value(started_at) AS started_at, any_value(cache_hit) AS cache_hit, any_value(total_duration_ms) AS total_duration_ms, any_value(vision_duration_ms) AS vision_duration_ms FROM metrics GROUP BY evaluation_id"
_LONG = f"SELECT model_version, strftime(date_trunc('week', started_at AT TIME ZONE 'UTC'), '%Y-%m-%d') AS week_start, cache_hit::BIGINT AS cache_hit, metric_name, value FROM (UNPIVOT ({_ONCE}) ON total_duration_ms, vision_duration_ms INTO NAME metric_name VALUE value) WHERE value > 0 AND model_version IS NOT NULL AND cache_hit IS NOT NULL"
ORACLE = {
    "p1_found": sql.p1_found(),
    "p1_forms": sql.p1_forms(),
    "p7_found": sql.p7_found(),
    "p3_found": f"SELECT model_version, week_start, cache_hit, metric_name, pct::BIGINT AS pct FROM (SELECT model_version, week_start, cache_hit, metric_name, count(*) AS n, count(*) FILTER (WHERE value <= 5000) AS le FROM ({_LONG}) GROUP BY ALL) CROSS JOIN (VALUES (50), (90)) AS p(pct) WHERE n >= 40 AND le < ceil(pct * n / 100.0)",
    "p3_within_bound": f"SELECT model_version, week_start, cache_hit, metric_name, pct::BIGINT AS pct, count(*) AS n, true AS within FROM ({_LONG}) CROSS JOIN (VALUES (50), (90), (99)) AS p(pct) GROUP BY ALL",
    "p8_kept": "SELECT regexp_replace(lower(trim(source)), '[\\s\\-]+', '_', 'g') AS source, true AS share_met, true AS repeats_kept FROM mix_target",
}
