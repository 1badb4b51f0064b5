"""Messages delivered more than once: an index of sorted identifier runs, searched batch by batch.

The index is a folder of immutable runs, each partitioned by hash prefix. A run has one row per prefix (in chunks): the
sorted 16-byte identifiers of that prefix, one after the other in one binary value, and the delivery that was kept
for each. An incoming batch is first deduplicated by itself (a partial aggregate, so a hot identifier collapses before
the shuffle), then co-grouped with the runs by prefix and binary-searched; the novel identifiers make the next run.
Only the folders of prefixes that the batch touches are read. Runs are merged by size: when ``merge_every`` runs of one
level are there, they become one run of the next, so an identifier is rewritten once a level. The list of runs is a
file in the folder, replaced with each batch, so another session can open the index and go on.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayist.functions.characters import plain
from assayist.session import shared_dir, written

#: Identifiers in one chunk of a run: 16 MB of them.
CHUNK = 1 << 20
RUN = "prefix int, ids binary, kept array<bigint>"


def identifier(col: Column) -> Column:
    """A 128-bit identifier, however it is printed, as 16 bytes; null for null and blank.

    Case, braces, hyphens, blanks, a ``urn:uuid:`` or ``0x`` before it don't count. A text that is no 128-bit number in
    hexadecimal stands for itself: it becomes the MD5 of its trimmed lower-case form.
    """
    low = F.lower(F.trim(plain(col)))
    digits = F.regexp_replace(F.regexp_replace(low, r"^\s*(urn:uuid:|uuid:|0x)", ""), r"[\s{}()\-]", "")
    return F.when(low.rlike(r"\S"), F.when(digits.rlike("^[0-9a-f]{32}$"), F.unhex(digits)).otherwise(F.unhex(F.md5(F.regexp_replace(low, r"\s+", " ")))))


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int") if bits else F.lit(0)


def _keys(values: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="S16")


def _run(prefix: int, keys: np.ndarray, kept: np.ndarray) -> pa.Table:
    """Rows of a run; keys are sorted here."""
    order = np.argsort(keys, kind="stable")
    keys, kept = keys[order], kept[order]
    cuts = range(0, max(len(keys), 1), CHUNK)
    return pa.table({"prefix": pa.array([prefix for _ in cuts], pa.int32()), "ids": pa.array([keys[i : i + CHUNK].tobytes() for i in cuts], pa.binary()), "kept": pa.array([kept[i : i + CHUNK] for i in cuts], pa.list_(pa.int64()))})


_EMPTY = pa.table({"prefix": pa.array([], pa.int32()), "ids": pa.array([], pa.binary()), "kept": pa.array([], pa.list_(pa.int64()))})


def _novel(batch: pa.Table, runs: pa.Table) -> pa.Table:
    """The identifiers of one prefix of a batch that no run holds, as a run of their own."""
    if not batch.num_rows:
        return _EMPTY
    keys = _keys(batch["key"].to_pylist())
    new = np.ones(len(keys), dtype=bool)
    for ids in runs["ids"].to_pylist():
        have = np.frombuffer(ids, dtype="S16")
        if len(have):
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            new &= have[at] != keys
    if not new.any():
        return _EMPTY
    return _run(batch["prefix"][0].as_py(), keys[new], batch["kept"].to_numpy()[new])


def _merged(runs: pa.Table) -> pa.Table:
    kept = runs["kept"].combine_chunks()
    return _run(runs["prefix"][0].as_py(), _keys(runs["ids"].to_pylist()), kept.flatten().to_numpy(zero_copy_only=False))


_LIST = "seq int, name string, level int, bits int"


class DeliveryIndex:
    """An index of the identifiers seen so far, kept as runs in ``root`` (a folder of the shared one unless given).

    ``prefix_bits`` fixes the number of hash prefixes; :meth:`sized` chooses it so that a prefix of ``expected``
    identifiers holds about a million. :meth:`open` takes up an index that another session has left.
    """

    def __init__(self, spark: SparkSession, prefix_bits: int, root: str | None = None, merge_every: int = 4):
        self.spark, self.bits, self.merge_every = spark, prefix_bits, merge_every
        self.root = root or f"{shared_dir(spark).rstrip('/')}/delivery-index-{uuid.uuid4().hex}"
        self.runs: list[tuple[str, int]] = []  # (name, level), the oldest first
        self._seq = 0

    @classmethod
    def sized(cls, spark: SparkSession, expected: int, **more) -> DeliveryIndex:
        return cls(spark, max(3, math.ceil(math.log2(max(1, expected / 1_000_000)))), **more)

    @classmethod
    def open(cls, spark: SparkSession, root: str, merge_every: int = 4) -> DeliveryIndex:
        """The index in ``root`` as its last complete batch left it; a folder without one is an error."""
        rows = spark.read.schema(_LIST).json(f"{root}/lists/*")
        last = rows.agg(F.max("seq")).first()[0]
        listed = sorted(rows.filter(F.col("seq") == last).collect(), key=lambda r: r["name"] or "")
        index = cls(spark, listed[0]["bits"], root, merge_every)
        index._seq, index.runs = last, [(r["name"], r["level"]) for r in listed if r["name"]]
        return index

    def _read(self, runs: list[tuple[str, int]], prefixes: list[int] | None = None) -> DataFrame:
        """Rows of runs; of the given prefixes only, whose folders are the only ones that are read."""
        parts = [self.spark.read.schema(RUN).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}") for name, _ in runs]
        out = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], RUN)
        return out if prefixes is None else out.filter(F.col("prefix").isin(prefixes))

    def _write(self, run: DataFrame, level: int) -> tuple[str, int]:
        name = f"run-{self._seq:06d}-{level}-{uuid.uuid4().hex[:8]}"
        run.write.partitionBy("prefix").parquet(f"{self.root}/{name}")
        return name, level

    def _commit(self) -> None:
        """Put the list of runs beside the older ones; a reader takes the newest complete one."""
        self._seq += 1
        rows = [(self._seq, n, v, self.bits) for n, v in self.runs] or [(self._seq, None, None, self.bits)]
        names = [c.split()[0] for c in _LIST.split(", ")]
        one = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(names, r, strict=True))) for r in rows))
        self.spark.range(1, numPartitions=1).select(F.inline(one)).write.json(f"{self.root}/lists/{self._seq:06d}")

    def add(self, batch: DataFrame, key: str, order: list[str], delivery: str) -> None:
        """Take in a batch: of each identifier that is novel, the first row by ``order`` is kept (nulls last)."""
        first = F.min(F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"_n_{c}"), F.col(c).alias(c)))))
        own = batch.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(first.alias("_f")).select(_prefix(F.col("key"), self.bits).alias("prefix"), "key", F.col(f"_f.{delivery}").alias("kept"))
        if self.runs:
            own = written(own, "batch")
            touched = [r[0] for r in own.select("prefix").distinct().collect()]  # at most 2**bits numbers
            found = own.groupBy("prefix").cogroup(self._read(self.runs, touched).groupBy("prefix")).applyInArrow(_novel, RUN)
        else:
            found = own.groupBy("prefix").applyInArrow(lambda t: _run(t["prefix"][0].as_py(), _keys(t["key"].to_pylist()), t["kept"].to_numpy()), RUN)
        self.runs.append(self._write(found, 0))
        self.merge()
        self._commit()

    def merge(self, everything: bool = False) -> None:
        """Merge runs of one level into one of the next; with ``everything`` all runs. The old ones stay for readers that still hold them."""
        while everything or max(Counter(v for _, v in self.runs).values(), default=0) >= self.merge_every:
            level = max(v for _, v in self.runs) if everything else min(v for v, n in Counter(v for _, v in self.runs).items() if n >= self.merge_every)
            group = [r for r in self.runs if everything or r[1] == level]
            if len(group) < 2:
                return
            one = self._write(self._read(group).groupBy("prefix").applyInArrow(_merged, RUN), level + 1)
            self.runs = [r for r in self.runs if r not in group] + [one]
            everything = False

    def kept(self) -> DataFrame:
        """The kept deliveries, one row each."""
        return self._read(self.runs).select(F.explode("kept").alias("kept"))


def _identified(df: DataFrame, id_col: str, time_col: str, delivery_col: str) -> DataFrame:
    return df.select(identifier(F.col(id_col)).alias("_key"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("_t"), F.col(delivery_col).alias("_d"))


def index_deliveries(df: DataFrame, id_col: str, time_col: str, delivery_col: str, batches: int = 4, merge_every: int = 4) -> tuple[DeliveryIndex, DataFrame]:
    """Replay a table through a :class:`DeliveryIndex` in ``batches`` slices of time, the earliest first; gives the index
    and the identified rows (_key, _t, _d).

    The table is read once and written by slice. Rows without a time come last. The first copy by (time, delivery) is the
    one that is kept.
    """
    rows = _identified(df, id_col, time_col, delivery_col)
    lo, hi, n = df.agg(F.min(time_col), F.max(time_col), F.count("*")).select(*(F.unix_micros(F.col(c).cast("timestamp")) for c in (f"min({time_col})", f"max({time_col})")), "count(1)").first()
    index = DeliveryIndex.sized(df.sparkSession, n, merge_every=merge_every)
    step = None if lo is None else max(1, -(-(hi + 1 - lo) // batches))
    part = F.lit(0) if lo is None else F.coalesce(F.floor((F.col("_t") - lo) / F.lit(step)).cast("int"), F.lit(batches - 1))
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/slices-{uuid.uuid4().hex}"
    rows.withColumn("_slice", part).write.partitionBy("_slice").parquet(path)
    sliced = df.sparkSession.read.schema(f"{_types(rows)}, _slice int").parquet(path).filter("_key is not null")  # filtered here, so that identifiers are made once
    for i in range(batches if lo is not None else 1):
        index.add(sliced.filter(F.col("_slice") == i), "_key", ["_t", "_d"], "_d")
    return index, sliced


def _types(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def repeated_deliveries(df: DataFrame, id_col: str, time_col: str, delivery_col: str, **more) -> DataFrame:
    """``delivery_col`` of the rows to drop: every copy of a message but its earliest.

    Rows with a null or blank identifier are never dropped; a null time sorts last; a tie goes to the smallest delivery.
    ``delivery_col`` must be unique and not null. Empty tables give no rows; other columns don't matter.
    """
    index, rows = index_deliveries(df, id_col, time_col, delivery_col, **more)
    return rows.select(F.col("_d").alias(delivery_col)).join(index.kept(), F.col(delivery_col) == F.col("kept"), "left_anti")


def deliver_once(df: DataFrame, id_col: str, time_col: str, delivery_col: str, **more) -> DataFrame:
    """The rows of ``df`` with exactly one copy of each message; all columns, as :func:`repeated_deliveries` decides."""
    gone = repeated_deliveries(df, id_col, time_col, delivery_col, **more).withColumnRenamed(delivery_col, "_gone")
    return df.join(gone, df[delivery_col] == gone["_gone"], "left_anti")
