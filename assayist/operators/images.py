"""Image quality over decoded grey values (array<array<double>>), in Arrow batches of numpy work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _measure(images: pa.Array) -> pa.Array:
    out = []
    for rows in images.to_pylist():
        if not rows or len(rows) < 3 or len(rows[0]) < 3:
            out.append(None)
            continue
        g = np.asarray(rows, dtype=float)
        lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
        f = np.abs(np.fft.fftshift(np.fft.fft2(g - g.mean()))) ** 2
        y, x = np.indices(g.shape)
        far = np.hypot((y - g.shape[0] // 2) / g.shape[0], (x - g.shape[1] // 2) / g.shape[1]) > 0.25
        out.append({"sharpness": float(lap.var()), "high_share": float(f[far].sum() / f.sum()) if f.sum() else 0.0})
    return pa.array(out, pa.struct([("sharpness", pa.float64()), ("high_share", pa.float64())]))


measure = F.arrow_udf(_measure, T.StructType([T.StructField("sharpness", T.DoubleType()), T.StructField("high_share", T.DoubleType())]))


def quality(m: Column, sharp: float = 50.0, high: float = 0.30) -> Column:
    """Why an image can't be read: low_resolution, motion_blur or null."""
    return F.when(m.sharpness < sharp, "low_resolution").when(m.high_share < high, "motion_blur")


def resolution(stated: Column, exif: Column, exif_unit: Column, declared: Column) -> Column:
    """Dots an inch: stated in the file, else in EXIF (by centimetre, too), else declared."""
    return F.coalesce(stated, F.when(exif_unit == "cm", exif * 2.54).otherwise(exif), declared)


def image_kind(content: Column) -> Column:
    """png or jpeg by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpeg")
