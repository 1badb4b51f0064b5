"""Queries of sources, sinks and streams: the test tables written and read back, replayed, consumed; beside their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayist.functions import text as X
from assayist.operators import windows
from assayist.session import read_table, shared_dir
from assayist.sources import readers, sinks
from assayist.streaming import events as stream

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_PLAIN = "nullif(trim(regexp_replace(replace({0}, chr(0), ''), '[\\r\\n]+', ' ', 'g')), '')"


@query(f"SELECT 'app-' || application_id AS filename, {_PLAIN.format('brand_name')} AS brand_name, {_PLAIN.format('applicant_name')} AS applicant_name_address, {_PLAIN.format('source_of_product')} AS source_of_product FROM application")
def applications_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applications written as CSV and read back: trimmed, blank as absent, no row lost or refused."""
    flat = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), "\\x00", ""), r"[\r\n]+", " ")
    df = read_table(spark, sf_dir, "application").select(F.concat(F.lit("app-"), F.col("application_id").cast("string")).alias("filename"), flat("brand_name").alias("brand_name"), flat("applicant_name").alias("applicant_name_address"), flat("source_of_product").alias("source_of_product"))
    sinks.write_applications(df, path := _folder(spark, "applications"))
    rows, _ = readers.applications(spark, path)
    return rows.select("filename", "brand_name", "applicant_name_address", "source_of_product")


@query("SELECT batch_id, count(*) AS n_items, count(*) FILTER (WHERE i.application_ref IS NULL) AS n_without FROM (SELECT batch_id, unnest(items) AS i FROM batch_submission WHERE len(items) BETWEEN 1 AND 100) GROUP BY 1")
def batches_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions written as JSON lines, read back and queued."""
    read_table(spark, sf_dir, "batch_submission").select("batch_id", "agent_id", "submitted_at", "items").write.json(path := _folder(spark, "batches"))
    items, _ = readers.batch_items(spark.read.schema(readers.BATCH).json(path))
    return items.groupBy("batch_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("application_ref").isNull()).alias("n_without"))


@query("SELECT evaluation_id, field_name, reason_code, CASE WHEN extracted_value IS NOT NULL THEN '' END AS extracted_value FROM field_finding WHERE observed_at::DATE >= (SELECT max(observed_at::DATE) - 7 FROM field_finding)")
def results_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings stored by day with their values blanked; the last seven days are read back by folder."""
    f = read_table(spark, sf_dir, "field_finding").select("evaluation_id", "field_name", "reason_code", "extracted_value", F.to_date("observed_at").alias("at"))
    sinks.write_results(f, path := _folder(spark, "results"), F.col("at"))
    stored = spark.read.parquet(path)
    last = stored.agg(F.max("day")).first()[0]
    return sinks.retained(spark, path, until=last).select("evaluation_id", "field_name", "reason_code", "extracted_value")


@query("SELECT batch_id, delivery_id FROM (SELECT batch_id, delivery_id, row_number() OVER (PARTITION BY batch_id ORDER BY delivery_id DESC) AS n FROM batch_message) WHERE n <= 20")
def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new subscriber of each batch is shown: its last twenty events."""
    return sinks.replay(read_table(spark, sf_dir, "batch_message").select("batch_id", "delivery_id"), "batch_id", ["delivery_id"], 20)


@query("SELECT evaluation_id, finding_id FROM (SELECT evaluation_id, finding_id, row_number() OVER (PARTITION BY evaluation_id ORDER BY observed_at DESC NULLS LAST, finding_id DESC) AS n FROM field_finding) WHERE n <= 3")
def last_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring buffer of three for each evaluation."""
    return windows.last_k(read_table(spark, sf_dir, "field_finding").select("evaluation_id", "observed_at", "finding_id"), "evaluation_id", ["observed_at", "finding_id"], 3).select("evaluation_id", "finding_id")


_PART = lambda c, v: f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":\"' || {v} || '\"' END"


@query(f"SELECT finding_id, '{{' || concat_ws(',', {_PART('evaluation_id', 'evaluation_id')}, {_PART('rule_id', 'rule_id')}, {_PART('extracted_value', repr(''))}) || '}}' AS value FROM field_finding")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as log lines of the allowed fields, values emptied, absent fields left out."""
    return sinks.log_lines(read_table(spark, sf_dir, "field_finding"), ["evaluation_id", "rule_id", "extracted_value"], ["extracted_value"], keep=["finding_id"])


@query("SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents WHERE text IS NOT NULL")
def composed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document with its letters composed."""
    return read_table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.md5(X.nfkc("NFC")("text")).alias("digest"))


_ITEMS = "SELECT batch_id, unnest(items) AS i, unnest(range(len(items))) AS position FROM batch_submission WHERE len(items) BETWEEN 1 AND 100"


@query(f"SELECT q.batch_id, q.position::BIGINT AS position, CASE WHEN a.application_id IS NULL THEN 'refusal' ELSE 'label-result' END AS event, CASE WHEN a.application_id IS NULL THEN 'INPUT.RECORD.MISSING' END AS code FROM ({_ITEMS}) q LEFT JOIN application a ON q.i.application_ref = 'app-' || a.application_id")
def stream_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of submissions, item by item: one without its application is refused and the batch goes on."""
    return _consumed(spark, sf_dir).select("batch_id", F.col("position").cast("bigint").alias("position"), "event", "code")


def _consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = readers.batch_items(stream.intake(spark, f"{sf_dir}/batch_submission.parque[t]", read_table(spark, sf_dir, "batch_submission").schema))
    known = read_table(spark, sf_dir, "application").select(F.concat(F.lit("app-"), F.col("application_id").cast("string")).alias("application_ref"))
    return stream.run_to_end(stream.consumed(items, known, "application_ref"), _folder(spark, "consumed"))


@query(f"SELECT q.batch_id, count(*) AS total, count(*) FILTER (WHERE a.application_id IS NULL) AS failed FROM ({_ITEMS}) q LEFT JOIN application a ON q.i.application_ref = 'app-' || a.application_id GROUP BY 1")
def stream_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each batch of a stream with its counts, once all items that were queued have come out."""
    done = _consumed(spark, sf_dir)
    items, _ = readers.batch_items(read_table(spark, sf_dir, "batch_submission"))
    return stream.ended(done, items.groupBy("batch_id").agg(F.count("*").alias("expected")), "batch_id")


@query("SELECT label_ref, arg_max(lean, (delivered_at, delivery_id)) AS lean FROM batch_message WHERE lean IS NOT NULL AND label_ref IS NOT NULL AND delivered_at IS NOT NULL GROUP BY 1")
def stream_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word on each label of a stream, at a snapshot after all of it."""
    rows = stream.intake(spark, f"{sf_dir}/batch_message.parque[t]", read_table(spark, sf_dir, "batch_message").schema).filter("lean is not null and label_ref is not null and delivered_at is not null")
    return stream.snapshot(stream.last_of(rows, ["label_ref"], ["delivered_at", "delivery_id"], "lean"), _folder(spark, "corrections"))
