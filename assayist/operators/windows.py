"""Window-shaped computations: M-of-N advisories, completed prefixes, gaps, ring buffers, ordered upserts, face merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACES = ["front", "back", "neck", "side"]


def face_rank(face: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, FACES)), face), F.lit(len(FACES) + 1))


def recurring(df: DataFrame, key: str, order: list[str], code: str, n: int = 10, m: int = 5) -> DataFrame:
    """Rows whose own code stands ``m`` times or more among the last ``n`` of their key, the row itself included.

    A null code takes a place in the window and never recurs.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)
    codes = F.collect_list(F.coalesce(F.col(code), F.lit(""))).over(w)
    return df.withColumn("times", F.size(F.filter(codes, lambda c: c == F.col(code)))).filter(F.col(code).isNotNull() & (F.col("times") >= m))


def first_advisory(df: DataFrame, key: str, order: list[str], code: str, n: int = 10, m: int = 5) -> DataFrame:
    """The advisory of each key that fires first and stays until it is dismissed."""
    return recurring(df, key, order, code, n, m).groupBy(key).agg(F.min_by(code, F.struct(*order)).alias("advisory_code"), F.min(F.struct(*order)).alias("at")).select(key, "advisory_code", "at.*")


def completed_prefix(df: DataFrame, key: str, order: str, done: Column) -> DataFrame:
    """Length of the prefix of each key in which everything is done."""
    so_far = F.min(F.when(done, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(order))
    return df.select(key, so_far.alias("_d")).groupBy(key).agg(F.sum("_d").cast("bigint").alias("cursor"))


def gaps(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Milliseconds since the row before, of the same key."""
    w = Window.partitionBy(key).orderBy(time, tie)
    return df.withColumn("gap_ms", F.floor((F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1000))


def last_k(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The last ``k`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def upserted(df: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """One row for each key: the last value written, in the place where the key was first written."""
    return df.groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.min(seq).alias("position"))


def merged_faces(obs: DataFrame, keys: list[str], ranks: list[Column], position: Column) -> DataFrame:
    """One observation of each field: the highest by ``ranks`` (nulls last), on a tie the one at the earlier ``position``.

    An aggregate, not a window: a hot field is combined map-side. ``position`` has to tell the rows of a field apart.
    """
    order = F.struct(*(F.struct(r.isNull(), -r.cast("double")) for r in ranks), position)
    rest = [c for c in obs.columns if c not in keys]
    return obs.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best")).select(*keys, "_best.*").select(*obs.columns)


def first_readable(obs: DataFrame, keys: list[str], value: str, position: Column) -> DataFrame:
    """The first value that isn't blank, by position; null if all are."""
    ok = F.when(F.trim(F.coalesce(F.col(value), F.lit(""))) != "", F.col(value))
    return obs.groupBy(*keys).agg(F.min_by(ok, F.when(ok.isNotNull(), position)).alias(value))


def paired_faces(files: DataFrame, stem: str, face: str, arrival: str) -> DataFrame:
    """Labels from files: the first file of each face of a stem belong together, a further one is a label of its own."""
    n = F.row_number().over(Window.partitionBy(stem, face).orderBy(arrival))
    one = files.withColumn("_n", n).withColumn("label", F.when(F.col("_n") == 1, F.col(stem)).otherwise(F.concat_ws("#", stem, face, F.col("_n").cast("string"))))
    faces = F.array_sort(F.collect_list(F.struct(face_rank(F.col(face)).alias("rank"), F.col(face).alias("face"), F.col(arrival).alias("file"))))
    return one.groupBy("label").agg(faces.alias("faces"), F.min(arrival).alias("arrived"))
