"""Distributed prefix sums: what all draws before a chunk of a series add up to.

Each chunk becomes one row of totals. These rows are added up inside spans of
``SPAN`` chunks, and the spans' ends once more, so no group holds more than a span
or the ends of a series' spans: a series of 10**12 draws has 120,000 of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from drawlake.spec import MAX_NUMBER

SPAN = 1024
SLICE = 1 << 13
LANES = np.arange(1, MAX_NUMBER + 1)
LIST = T.ArrayType(T.LongType())


def number_bits(masks: np.ndarray) -> np.ndarray:
    """One row per mask, one column per number: 1 if the mask holds it."""
    return (masks[:, None] >> LANES) & 1


def as_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column of one entry per number as a matrix."""
    return column.combine_chunks().flatten().to_numpy().reshape(-1, MAX_NUMBER)


def as_lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, matrix.size + 1, MAX_NUMBER, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel().astype(np.int64)))


def _summed(pools: tuple[str, ...], keys: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Totals of one chunk: times of each number, and the latest position that has it, 0 if none."""

    def run(chunk: pa.Table) -> pa.Table:
        columns = {k: chunk[k][:1] for k in keys}
        rk = chunk["rk"].to_numpy()
        for pool in pools:
            masks = chunk[f"{pool}_mask"].to_numpy()
            count, last = np.zeros(MAX_NUMBER, np.int64), np.zeros(MAX_NUMBER, np.int64)
            for at in range(0, len(rk), SLICE):
                bits = number_bits(masks[at : at + SLICE])
                count += bits.sum(axis=0)
                last = np.maximum(last, (bits * rk[at : at + SLICE, None]).max(axis=0))
            columns |= {f"{pool}_count": as_lists(count), f"{pool}_last": as_lists(last)}
        return pa.table(columns)

    return run


def _before(order: str, values: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Each row's values become those of all rows before it; one more row, without ``order``, has those of all."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        columns = {}
        for name in rows.schema.names:
            if name in values:
                matrix = as_matrix(rows[name])
                total = np.cumsum(matrix, axis=0) if name.endswith("_count") else np.maximum.accumulate(matrix, axis=0)
                columns[name] = as_lists(np.vstack([np.zeros((1, MAX_NUMBER), np.int64), total]))
            else:
                again = pa.array([*range(len(rows)), None if name == order else 0])
                columns[name] = rows[name].take(again)
        return pa.table(columns)

    return run


def carried_totals(rows: DataFrame, series_cols: list[str], pools: tuple[str, ...], size: int) -> DataFrame:
    """Totals of all draws of the series before each chunk: series, _chunk, {pool}_count, {pool}_last.

    ``rows`` has the series, rk and the masks of the pools; chunk k holds the positions
    k * size + 1 to (k + 1) * size. The lists have one entry per number.
    """
    values = [f"{p}_{what}" for p in pools for what in ("count", "last")]
    chunked = rows.withColumn("_chunk", F.floor((F.col("rk") - 1) / size).cast("bigint"))
    keys = [*series_cols, "_chunk"]
    schema = T.StructType([chunked.schema[k] for k in keys] + [T.StructField(v, LIST) for v in values])
    own = chunked.groupBy(*keys).applyInArrow(_summed(pools, keys), schema)
    spanned = own.withColumn("_span", F.floor(F.col("_chunk") / SPAN).cast("bigint"))
    inside = spanned.groupBy(*series_cols, "_span").applyInArrow(_before("_chunk", values), spanned.schema)
    ends = inside.filter("_chunk IS NULL").drop("_chunk")
    earlier = ends.groupBy(*series_cols).applyInArrow(_before("_span", values), ends.schema)
    renamed = earlier.select(*series_cols, "_span", *[F.col(v).alias(f"_earlier_{v}") for v in values])

    def both(name: str):
        add = (lambda a, b: a + b) if name.endswith("_count") else (lambda a, b: F.greatest(a, b))
        return F.zip_with(name, f"_earlier_{name}", add).alias(name)

    return (
        inside.filter("_chunk IS NOT NULL")
        .join(renamed, [*series_cols, "_span"])
        .select(*series_cols, "_chunk", *[both(v) for v in values])
    )
