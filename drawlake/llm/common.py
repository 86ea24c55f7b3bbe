"""Session settings, intermediate tables and Arrow text access shared by the operators."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Arrow batches are bounded by bytes, so that long texts do not add up in a Python worker.
# Shuffle files of a finished step go at once: each step ends in a written table.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark, ROOT)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def saved(frame: DataFrame, label: str, compression: str = "snappy", partition_by: str | None = None) -> DataFrame:
    """``frame`` written below the shared folder and read again.

    A step that is used twice, or whose result feeds a join that may be skewed,
    is cut here: a lost executor costs a reread, not a recomputation.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path, compression=compression, partitionBy=partition_by)
    return spark.read.schema(frame.schema).parquet(path)


def numbered_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str | Column] | None = None
) -> DataFrame:
    """``docs`` as a stored table: row, doc_id (whole number), text, and ``carry`` as the fields of ``carried``.

    ``row`` is unique and rises with (id, hash of the text), rows without an id last.
    Rows that share an id have an order that way which doesn't depend on the order of
    the input; rows that share id and text are alike. They are dealt out by one range
    shuffle, in which a last, arbitrary key parts even rows that are alike.
    """
    fields = [F.struct(*carry).alias("carried")] if carry else []
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *fields).withColumns(
        {"mark": F.xxhash64("text"), "salt": F.monotonically_increasing_id()}
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("salt")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(dealt.select(F.monotonically_increasing_id().alias("row"), *keyed.columns[:-2]), "rows", "zstd")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges whose texts hold at most ``most`` bytes together; a longer text is alone."""
    out, start, rows = [], 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        out.append((start, stop))
        start = stop
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = ASCII_SPACE):
    """Start and end byte of every word, and the n + 1 word offsets of the texts.

    ``separator`` tells for each byte value whether it parts words; texts never share a word.
    """
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(offsets))
    opens, closes = offsets[:-1][filled], offsets[1:][filled] - 1
    first[opens] = inside[opens]
    last[closes] = inside[closes]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


# Base and inverse of the byte hash, and the multipliers of its mixing step: fixed odd values.
BASE = 0x9E3779B97F4A7C15
UNDO = pow(BASE, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; kept and grown by doubling."""
    table = _TABLES.get(base)
    if table is None or len(table) < count:
        size = 1 << max(10, int(count - 1).bit_length())
        table = np.empty(size, np.uint64)
        table[0] = 1
        done = 1
        while done < size:
            table[done : 2 * done] = table[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        if size <= 1 << 21:
            _TABLES[base] = table
    return table[:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (values ^ (values >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """Polynomial hashes of the bytes from ``starts`` to each of ``ends``, from running sums, mixed."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in ends]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    back = powers(UNDO, len(data))[starts]
    return [mixed((sums[end] - sums[starts]) * back + (end - starts).astype(np.uint64)) for end in ends]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(data, starts, [ends])[0]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive words, from running sums; one per start."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * powers(UNDO, len(words))[:count])
