"""Sinks: application CSV, results by day with retention, events with replay, JSON-lines log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayist.operators.records import rounded_boxes
from assayist.sources.readers import APPLICATION

BLANKED = ("extracted_value", "expected_value", "explanation", "label_ref")


def write_applications(df: DataFrame, path: str) -> None:
    """The fixed columns as CSV with CRLF; an absent value is blank."""
    df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in APPLICATION)).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def freeze_readings(df: DataFrame, path: str, version: int = 2) -> None:
    """Readings (image, frame_size, rotation_deg, boxes, ...) as JSON of a stated version, coordinates and scores rounded, so that they read back alike."""
    df.withColumn("schema_version", F.lit(version)).withColumn("boxes", rounded_boxes(F.col("boxes"))).write.mode("overwrite").json(path)


def blanked(df: DataFrame, columns: tuple[str, ...] = BLANKED) -> DataFrame:
    """Value-bearing texts emptied; ids, codes and geometry stay. Nested findings keep their shape."""
    out = [F.when(F.col(c).isNotNull(), F.lit("")).alias(c) if c in columns else F.col(c) for c in df.columns]
    return df.select(out)


def write_results(df: DataFrame, path: str, day: Column) -> None:
    """Results partitioned by day, so that retention drops whole folders."""
    blanked(df).withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def retained(spark: SparkSession, path: str, days: int = 7, until: date | None = None) -> DataFrame:
    """Results of the last ``days`` days, up to today unless another day is given; a partition filter."""
    last = F.current_date() if until is None else F.lit(until)
    return spark.read.parquet(path).filter(F.col("day") >= F.date_sub(last, days))


def log_lines(df: DataFrame, allowed: list[str], secret: list[str], keep: list[str] = ()) -> DataFrame:
    """Allowed fields as JSON lines, secret ones emptied, absent ones left out; beside the columns ``keep``."""
    line = F.struct(*(F.when(F.col(c).isNotNull(), F.lit("")).alias(c) if c in secret else F.col(c) for c in allowed))
    return df.select(*keep, F.to_json(line).alias("value"))


def replay(df: DataFrame, key: str, order: list[str], most: int = 1000) -> DataFrame:
    """What a new subscriber is shown: the last ``most`` events of its key, in order."""
    from assayist.operators.windows import last_k

    return last_k(df, key, order, most).orderBy(key, *order)
