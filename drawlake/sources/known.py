"""Bitmap index of the draw numbers that a history holds.

One row covers 32,768 numbers of a pool in 4 KB, so a billion draws are 125 MB, and
a lookup reads the rows of the numbers that it asks for. Bitmaps merge by OR, which
makes appending twice the same as once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from drawlake.sources.segments import SegmentedTable

KEYS = ["lottery_type", "draw_no"]
SCHEMA = T.StructType(
    [
        T.StructField("lottery_type", T.StringType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("bitmap", T.BinaryType()),
    ]
)
# A batch with more buckets than this reads the whole index, of which that is a fair share then.
MOST_LISTED = 4096


def _bucket(number: str) -> Column:
    return F.bitmap_bucket_number(F.col(number))


def index_of(rows: DataFrame) -> DataFrame:
    """Index rows of all keys; copies and rows of the same bucket combine before the shuffle."""
    known = rows.filter(F.col("draw_no").isNotNull()).select(
        "lottery_type", _bucket("draw_no").alias("bucket"), F.bitmap_bit_position("draw_no").alias("_bit")
    )
    return known.groupBy("lottery_type", "bucket").agg(F.bitmap_construct_agg("_bit").alias("bitmap"))


def merged_index(index: DataFrame) -> DataFrame:
    return index.groupBy("lottery_type", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def known_numbers(spark: SparkSession, path: str) -> SegmentedTable:
    """The stored index below ``path``; each append is a batch of it."""
    return SegmentedTable(spark, path, SCHEMA, key="bucket", combine=merged_index)


def touched(rows: DataFrame) -> list[tuple[str, int]] | None:
    """Pools and buckets of the keys of a batch, None if there are too many to list. Takes an action."""
    keys = rows.filter(F.col("draw_no").isNotNull() & F.col("lottery_type").isNotNull())
    found = keys.select("lottery_type", _bucket("draw_no").alias("bucket")).distinct().limit(MOST_LISTED + 1).collect()
    return [tuple(r) for r in found] if len(found) <= MOST_LISTED else None


def lookup(index: SegmentedTable, rows: DataFrame, before: int | None = None) -> DataFrame:
    """Index rows of the buckets that ``rows`` touch; other segments and row groups are not read."""
    wanted = touched(rows)
    if wanted is None:
        return index.read(before)
    by_pool: dict[str, list[int]] = {}
    for kind, bucket in wanted:
        by_pool.setdefault(kind, []).append(bucket)
    found = index.read(before, {kind: (min(b), max(b)) for kind, b in by_pool.items()})
    test = F.lit(False)
    for kind, buckets in by_pool.items():
        test = test | ((F.col("lottery_type") == kind) & F.col("bucket").isin(buckets))
    return found.filter(test)


def mark_known(rows: DataFrame, index_rows: DataFrame) -> DataFrame:
    """``rows`` with ``known``: whether the index has their key; rows without a number or pool are not known."""
    bit = F.bitmap_bit_position("draw_no")
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    one = merged_index(index_rows).select(
        F.col("lottery_type").alias("_kind"), F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")
    )
    joined = rows.join(one, (F.col("lottery_type") == F.col("_kind")) & (_bucket("draw_no") == F.col("_bucket")), "left")
    known = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return joined.withColumn("known", known).drop("_kind", "_bucket", "_bitmap")
