"""Percentiles of very large numeric columns: dyadic Count-sketches.

A value is encoded to a whole number that keeps its order and its leading ``mantissa`` bits (relative error
2**-mantissa). For each binary resolution of the code there is one signed Count-sketch (resolutions with fewer cells than
a sketch has counters are counted exactly). Sketches are arrays of whole numbers: they are merged by addition over files,
days or partitions, and a value is deleted by adding it with weight -1. A rank is inverted by descending the resolutions.
A sketch of few codes is stored as those codes and their weights, which are added like the counters that they stand for.

In a plan: values are counted by (group, piece, code) with a map-side combine, so a hot group collapses before the
shuffle and no task sees more than the codes of one piece; each piece becomes one sketch of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayist.session import small, written


@dataclass(frozen=True)
class Shape:
    """Size of a sketch: values up to 2**value_bits, sketches of depth x width counters for each resolution."""

    mantissa: int = 9
    value_bits: int = 31
    depth: int = 5
    width: int = 256

    @property
    def levels(self) -> int:
        return (self.value_bits - self.mantissa + 1).bit_length() + self.mantissa

    def cells(self, level: int) -> int:
        return 1 << (self.levels - level)

    def exact(self, level: int) -> bool:
        return self.cells(level) <= self.depth * self.width

    def length(self, level: int) -> int:
        return self.cells(level) if self.exact(level) else self.depth * self.width

    @property
    def size(self) -> int:
        """Counters of all levels."""
        return sum(map(self.length, range(self.levels + 1)))

    def encode(self, v: Column) -> Column:
        """Code of a whole number > 0, in the JVM; a value that the shape has no code for is an error, never another code."""
        v = v.cast("bigint")
        e = F.greatest(F.length(F.bin(v)) - F.lit(self.mantissa + 1), F.lit(0))
        code = (e * F.lit(1 << self.mantissa) + F.call_function("shiftright", v, e)).cast("int")
        return F.when(v < F.lit(1 << self.value_bits), code).otherwise(F.raise_error(F.concat(F.lit(f"a value of more than {self.value_bits} bits needs a wider shape: "), v.cast("string"))).cast("int"))

    def code(self, v: int) -> int:
        e = max(int(v).bit_length() - self.mantissa - 1, 0)
        return (e << self.mantissa) + (int(v) >> e)

    def decode(self, code: int) -> int:
        """The largest value of a code."""
        e = max((code >> self.mantissa) - 1, 0)
        return ((code - (e << self.mantissa) + 1) << e) - 1


def _hash(items: np.ndarray, level: int, row: int) -> np.ndarray:
    """64 mixed bits of each item (splitmix), other ones for each level and row."""
    with np.errstate(over="ignore"):
        z = items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level * 64 + row + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_DENSE, _SPARSE = b"counters", b"codes\0\0\0"


class Sketch:
    """One dyadic Count-sketch. ``data``: the counters of all levels, one after the other."""

    def __init__(self, shape: Shape, data: np.ndarray | None = None):
        self.shape = shape
        self.at = np.concatenate([[0], np.cumsum([shape.length(i) for i in range(shape.levels + 1)])])
        self.data = np.zeros(self.at[-1], np.int64) if data is None else data

    @classmethod
    def of(cls, shape: Shape, blobs: Iterable[bytes]) -> Sketch:
        """The sum of stored sketches: counters are added, codes of small ones are added as values."""
        out, sparse = cls(shape), []
        for blob in blobs:
            body = np.frombuffer(blob, np.int64, offset=8)
            if blob[:8] == _DENSE:
                out.data += body
            else:
                sparse.append(body.reshape(2, -1))
        if sparse:
            out.add(*np.concatenate(sparse, axis=1))
        return out

    @classmethod
    def stored(cls, shape: Shape, codes: np.ndarray, weights: np.ndarray) -> tuple[int, bytes]:
        """(n, bytes) of the values: codes and weights if these are smaller than the counters."""
        if 2 * len(codes) < shape.size:
            return int(weights.sum()), _SPARSE + np.concatenate([codes, weights]).astype(np.int64).tobytes()
        s = cls(shape).add(codes, weights)
        return s.n, _DENSE + s.data.tobytes()

    def level(self, i: int) -> np.ndarray:
        return self.data[self.at[i] : self.at[i + 1]]

    def add(self, codes: np.ndarray, weights: np.ndarray) -> Sketch:
        """Add values by code; a negative weight deletes."""
        for i in range(self.shape.levels + 1):
            items, c = codes >> i, self.level(i)
            if self.shape.exact(i):
                np.add.at(c, items, weights)
            else:
                for r in range(self.shape.depth):
                    h = _hash(items, i, r)
                    slot = (h % np.uint64(self.shape.width)).astype(np.int64) + r * self.shape.width
                    np.add.at(c, slot, np.where(h >> np.uint64(63), weights, -weights))
        return self

    def merge(self, other: Sketch) -> Sketch:
        self.data = self.data + other.data
        return self

    @property
    def n(self) -> int:
        return int(self.level(self.shape.levels)[0])

    def count(self, level: int, item: int) -> float:
        c = self.level(level)
        if self.shape.exact(level):
            return float(c[item])
        one, est = np.array([item]), []
        for r in range(self.shape.depth):
            h = int(_hash(one, level, r)[0])
            est.append((1 if h >> 63 else -1) * int(c[h % self.shape.width + r * self.shape.width]))
        return float(np.median(est))

    def rank(self, code: int) -> float:
        """Estimated number of values whose code is below ``code``."""
        return sum(self.count(i, (code >> i) - 1) for i in range(self.shape.levels + 1) if code >> i & 1)

    def error(self, sigmas: float = 4.0) -> float:
        """Bound of the error of a rank: a multiple of the sketches' standard errors, at most one cell a level."""
        var = 0.0
        for i in range(self.shape.levels + 1):
            if not self.shape.exact(i):
                rows = self.level(i).reshape(self.shape.depth, self.shape.width).astype(float)
                var += float(np.median((rows**2).sum(axis=1))) / self.shape.width
        return sigmas * var**0.5

    def quantile(self, rank: int) -> int:
        """Code of the ``rank``-th smallest value (1 is the first), by descending the levels."""
        item, left = 0, float(rank)
        for i in range(self.shape.levels - 1, -1, -1):
            item <<= 1
            below = self.count(i, item)
            if below < left:
                left -= below
                item += 1
        return item


def coded(values: DataFrame, groups: list[str], piece: str, value: str, shape: Shape = Shape(), weight: str | None = None, **sums: Column) -> DataFrame:
    """Counts by group, piece and code: the input of :func:`sketches`. ``sums``: further sums to carry along.

    Values that are null or not above 0 are left out; null groups are groups of their own.
    """
    v = values.filter(F.col(value) > 0)
    w = F.lit(1) if weight is None else F.col(weight)
    return v.groupBy(*groups, piece, shape.encode(F.col(value)).alias("code")).agg(F.sum(w).cast("bigint").alias("n"), *(F.sum(c).cast("bigint").alias(k) for k, c in sums.items()))


def sketches(counts: DataFrame, keys: list[str], shape: Shape = Shape()) -> DataFrame:
    """One sketch for each value of ``keys``, as (keys, n, sketch binary)."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema if f.name in keys)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, blob = Sketch.stored(shape, rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
        return pd.DataFrame([[*key, n, blob]], columns=[*keys, "n", "sketch"])

    return counts.select(*keys, "code", "n").groupBy(*keys).applyInPandas(build, f"{types}, n bigint, sketch binary")


def merged(pieces: DataFrame, keys: list[str], pcts: list[int], shape: Shape = Shape(), above: int | None = None) -> DataFrame:
    """Add the sketches of each group and read percentiles off.

    One row for each group and percentage: n, value (upper end of the code's values), rank_error, and, with ``above``,
    n_least and n_most: estimates between which the number of values at or below it lies, up to rank_error. The two
    differ by the values that share its code. ``keys`` must leave few pieces a group.
    """
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in keys)

    def read(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = Sketch.of(shape, rows["sketch"])
        c = None if above is None else shape.code(above)
        least, most = (None, None) if c is None else (total.rank(c if shape.decode(c) > above else c + 1), total.rank(c + 1))
        out = [[*key, p, total.n, shape.decode(total.quantile(max(1, -(-p * total.n // 100)))), total.error(), least, most] for p in pcts]
        return pd.DataFrame(out, columns=[*keys, "pct", "n", "value", "rank_error", "n_least", "n_most"])

    return pieces.select(*keys, "sketch").groupBy(*keys).applyInPandas(read, f"{types}, pct bigint, n bigint, value bigint, rank_error double, n_least double, n_most double")


def above(counts: DataFrame, groups: list[str], piece: str, pcts: list[int], limit: int, least: int, at_most: str, shape: Shape = Shape()) -> DataFrame:
    """(groups, pct) whose percentile lies above ``limit``, of groups with at least ``least`` values: the sketches decide.

    ``counts``: see :func:`coded`, with ``at_most``, the number of values at or below the limit. A percentage is decided by
    the merged sketches when their bound of the rank's error allows; only groups within that bound of the limit are
    counted exactly.
    """
    t = merged(sketches(counts, [*groups, piece], shape), groups, pcts, shape, limit).filter(F.col("n") >= least)
    need = F.ceil(F.col("pct") * F.col("n") / F.lit(100))
    yes, no = F.col("n_most") + F.col("rank_error") < need, F.col("n_least") - F.col("rank_error") >= need
    rated = written(t.filter(~no).select(*groups, "pct", need.alias("need"), yes.alias("sure")), "rated")
    doubt = rated.filter(~F.col("sure"))
    same = [counts[g].eqNullSafe(F.col(f"_d.{g}")) for g in groups]
    exact = counts.join(small(doubt.select(groups).distinct()).alias("_d"), same, "left_semi").groupBy(*groups).agg(F.sum(at_most).alias("_at_most"))
    e = exact.select(*(F.col(g).alias(f"_e_{g}") for g in groups), "_at_most")
    checked = doubt.join(e, [F.col(g).eqNullSafe(F.col(f"_e_{g}")) for g in groups]).filter(F.col("_at_most") < F.col("need"))
    return rated.filter("sure").select(*groups, "pct").unionByName(checked.select(*groups, "pct"))


def unpivoted(metrics: DataFrame) -> DataFrame:
    """One row for each evaluation and duration: model_version, week_start, day, cache_hit, metric_name, value.

    An evaluation stored twice counts once. Days and weeks are UTC whatever the session's time zone is.
    """
    days = F.floor(F.unix_micros("started_at") / F.lit(86_400_000_000)).cast("int")
    day = F.date_from_unix_date(days)
    week = F.date_from_unix_date(days - F.pmod(days + F.lit(3), F.lit(7)))
    rows = metrics.select("evaluation_id", "model_version", "started_at", "cache_hit", "total_duration_ms", "vision_duration_ms")
    fields = F.struct("started_at", "model_version", "cache_hit", "total_duration_ms", "vision_duration_ms")
    once = rows.filter(F.col("evaluation_id").isNotNull()).groupBy("evaluation_id").agg(F.min(fields).alias("f")).select("f.*")
    all_rows = once.unionByName(rows.filter(F.col("evaluation_id").isNull()).select(*once.columns))
    base = all_rows.filter(F.col("model_version").isNotNull() & F.col("cache_hit").isNotNull() & F.col("started_at").isNotNull())
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric_name"), F.col(m).alias("value")) for m in ("total_duration_ms", "vision_duration_ms")))).alias("m")
    return base.select("model_version", week.cast("string").alias("week_start"), day.cast("string").alias("day"), F.col("cache_hit").cast("bigint").alias("cache_hit"), pairs).select("model_version", "week_start", "day", "cache_hit", "m.metric_name", "m.value")
