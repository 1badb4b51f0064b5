"""Streaming forms: latched advisories with dismissal, one copy of each message, overrides, the end of a batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADVISORY = "key string, advisory_code string, seq bigint"
STATE = "codes array<string>, outstanding string"


def _advise(n: int, m: int):
    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        codes, outstanding = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            if row.event == "dismiss":
                if outstanding is not None and row.code == outstanding:
                    codes, outstanding = [], None
                continue
            code = row.code if isinstance(row.code, str) else ""
            codes = [*codes, code][-n:]
            if code and outstanding is None and codes.count(code) >= m:
                outstanding = code
                out.append((str(key[0]), code, int(row.seq)))
        state.update((codes, outstanding))
        yield pd.DataFrame(out, columns=["key", "advisory_code", "seq"])

    return run


def advisories(events: DataFrame, key: str, n: int = 10, m: int = 5) -> DataFrame:
    """Advisories of a stream of (key, seq, event, code): fires when a code fills ``m`` of the last ``n`` places, then holds
    until that code is dismissed (event ``dismiss``), which clears the window. Events of one trigger are taken by seq."""
    return events.select(F.col(key).cast("string").alias("key"), "seq", "event", "code").groupBy("key").applyInPandasWithState(_advise(n, m), ADVISORY, STATE, "append", GroupStateTimeout.NoTimeout)


def once(stream: DataFrame, keys: list[str], time: str, delay: str | None = None) -> DataFrame:
    """The first copy of each message of a stream; with a delay, state older than it is let go."""
    return stream.dropDuplicates(keys) if delay is None else stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def ended(events: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Batches that are complete: key, total, failed. ``sizes``: key, expected. Batch form, or a stream in update mode."""
    seen = events.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("event") == "refusal").alias("failed"))
    return seen.join(sizes, key).filter(F.col("total") >= F.col("expected")).select(key, "total", "failed")


def consumed(items: DataFrame, records: DataFrame, ref: str) -> DataFrame:
    """Results of queued items (batch_id, position, ``ref``), one each: an item whose record is missing is a refusal, never the end of its batch.

    A stateless join to static ``records`` (``ref``, ...): items of a trigger come out with it, whatever fails.
    """
    known = records.select(F.col(ref).alias("_ref")).distinct().withColumn("_here", F.lit(True))
    here = items.join(known, F.col(ref) == F.col("_ref"), "left")
    missing = F.col("_here").isNull()
    return here.select("batch_id", "position", ref, F.when(missing, "refusal").otherwise("label-result").alias("event"), F.when(missing, "INPUT.RECORD.MISSING").alias("code"))


def intake(spark: SparkSession, path: str, schema, files_at_once: int = 4) -> DataFrame:
    """A stream of Parquet files, of which a trigger takes ``files_at_once``: the rest waits, so a slow consumer holds the intake back."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def counted(events: DataFrame, key: str) -> DataFrame:
    """Totals so far of each batch: total, failed. A stream in complete mode."""
    return events.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("event") == "refusal").alias("failed"))


def last_of(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each key so far; a stream in complete mode. Corrections that come while a batch runs are folded like this."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def snapshot(df: DataFrame, path: str, wait: int | None = None) -> DataFrame:
    """What a stream's totals are when all that is there has been taken in, or after ``wait`` seconds: the last complete table under ``path``."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/at-{number:09d}")

    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{path}/at-none")
    q = df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    if not q.awaitTermination(wait) if wait else q.awaitTermination():
        q.stop()
    spark = df.sparkSession
    done = spark.read.schema(df.schema).parquet(f"{path}/at-*")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/at-(\d+)/", 1)
    rows = done.select("*", number.alias("_at"))
    last = rows.agg(F.max("_at")).first()[0]
    return rows.filter(F.col("_at") == last).drop("_at")


def run_to_end(df: DataFrame, path: str) -> DataFrame:
    """Run an appending stream over what is there into Parquet under ``path``, and read that."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")
