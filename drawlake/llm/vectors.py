"""Reading vector columns: valid rows, whole-number components and numpy access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def scaled(vector: Column, factor: int, plus: int = 0) -> Column:
    """floor(factor * component) + plus as whole numbers, components taken as doubles."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(factor)) * c.cast("double")) + F.lit(plus))


def widest(frame: DataFrame, vector: str) -> int:
    """Number of components of the longest vector; 0 for an empty table."""
    return frame.agg(F.max(F.size(vector)).alias("width")).first()["width"] or 0


def padded(vector: Column, width: int, fill: int = 0) -> Column:
    """Missing components at the end count as ``fill``."""
    return F.concat(vector, F.array_repeat(F.lit(fill).cast("bigint"), F.greatest(F.lit(0), F.lit(width) - F.size(vector))))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as a matrix of whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(rows, len(flat) // rows if rows else 0)
