"""Vector columns as whole numbers: which rows take part, and their components as integer matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, *carried: str, vector: str = "embedding") -> DataFrame:
    """The carried columns and `v` (array<double>) of rows whose vector is not null and holds finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(*carried, F.col(vector).cast("array<double>").alias("v"))


def extent(rows: DataFrame) -> tuple[int, int, float]:
    """Rows, components of the longest vector, and the largest magnitude of a component."""
    top = F.array_max(F.transform("v", F.abs))
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(top)).first()
    return n, width or 0, most or 0.0


def integers(vectors: pa.ListArray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) as an int64 matrix; shorter vectors end in zeros."""
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = np.floor(np.asarray(vectors.flatten(), dtype=np.float64) * scale).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
