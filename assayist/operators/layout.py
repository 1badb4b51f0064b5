"""Two-dimensional layout over boxes (key, box, x0, y0, x1, y1, text): columns, rows, reading order, neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def columns_of(boxes: DataFrame, key: str, share: float = 0.08, least: float = 8.0) -> DataFrame:
    """Adds ``column``: boxes are split at vertical gutters at least ``share`` of the span and ``least`` wide; fewer than 4 boxes have one."""
    w = Window.partitionBy(key)
    left = w.orderBy("x0", "x1", "box")
    reach = F.max("x1").over(left.rowsBetween(Window.unboundedPreceding, -1))
    df = boxes.withColumn("_reach", reach).withColumn("_span", F.max("x1").over(w) - F.min("x0").over(w)).withColumn("_n", F.count("*").over(w))
    opens = (F.col("_n") >= 4) & (F.col("x0") - F.col("_reach") >= F.greatest(F.col("_span") * share, F.lit(least)))
    return df.withColumn("column", F.sum(F.when(opens, 1).otherwise(0)).over(left)).drop("_reach", "_span", "_n")


def reading_order(boxes: DataFrame, key: str) -> DataFrame:
    """Adds ``row`` and ``position``: columns from the left, rows of 0.7 median heights (half to even), then from the left."""
    df = columns_of(boxes, key)
    height = df.groupBy(key, "column").agg(F.median(F.col("y1") - F.col("y0")).alias("_h"))
    df = df.join(height, [key, "column"]).withColumn("row", F.rint(F.col("y0") / F.greatest(F.col("_h") * 0.7, F.lit(1e-9))).cast("bigint"))
    return df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("column", "row", "x0", "box"))).drop("_h")


def lines(boxes: DataFrame, key: str, overlap: float = 0.5) -> DataFrame:
    """Adds ``line``: a box joins the line to its left whose last box it overlaps by half its height. Greedy, so one face at a time."""

    def group(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["x0", "y0", "box"], kind="stable")
        ends: list[tuple[float, float]] = []
        out = []
        for y0, y1 in zip(df["y0"], df["y1"], strict=True):
            fit = [(min(y1, b) - max(y0, a), -i) for i, (a, b) in enumerate(ends) if min(y1, b) - max(y0, a) >= overlap * max(min(y1 - y0, b - a), 1e-9)]
            i = -max(fit)[1] if fit else len(ends)
            ends[i : i + 1] = [(y0, y1)]
            out.append(i)
        return df.assign(line=out)

    return boxes.groupBy(key).applyInPandas(group, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema) + ", line int")


def union_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def beneath(boxes: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, box, other, rank): the ``k`` nearest boxes beneath each box that overlap it from side to side, within a face."""
    a, b = boxes.alias("a"), boxes.alias("b")
    near = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.y0") >= F.col("a.y1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("b.x1") > F.col("a.x0")))
    pairs = near.select(F.col(f"a.{key}").alias(key), F.col("a.box").alias("box"), F.col("b.box").alias("other"), (F.col("b.y0") - F.col("a.y1")).alias("gap"))
    w = Window.partitionBy(key, "box").orderBy("gap", "other")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def largest_type(boxes: DataFrame, key: str) -> DataFrame:
    """The text set in the largest type, the first in order on a tie."""
    return boxes.groupBy(key).agg(F.max_by("text", F.struct((F.col("y1") - F.col("y0")).alias("size"), (-F.col("box")).alias("pos"))).alias("text"))
