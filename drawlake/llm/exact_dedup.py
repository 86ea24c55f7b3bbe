"""Exact dedup: two-pass Bloom filtering, so that only possibly repeated rows shuffle.

DataFrame functions only. The first pass reads the texts once and keeps a digest
row per document. Digest rows set bits in a blocked Bloom filter that remembers
"set by two rows or more"; the second pass probes it. Rows with an unshared bit
are unique and go straight to the result; the others are grouped by digest. A filter
that is too large to broadcast is cut into ranges of blocks, probed one after the
other, so unique rows never shuffle.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, saved

# Spark's bitmap functions use 4096 bytes a bitmap.
BLOCK_BITS = 8 * 4096
PROBES = 2


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _probes(bits_of: str) -> Column:
    """Bit positions of a row inside its block, without repeats."""
    return F.array_distinct(
        F.array(*[F.pmod(F.xxhash64(F.lit(j), F.col(bits_of)), F.lit(BLOCK_BITS)) for j in range(1, PROBES + 1)])
    )


def shared_bits(digests: DataFrame) -> DataFrame:
    """Bloom filter rows (block, bitmap): the bits that at least two digest rows set."""
    return (
        digests.select("block", F.explode(_probes("digest")).alias("bit"))
        .groupBy("block", "bit")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def _bit_is_set(bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def _probed(digests: DataFrame) -> DataFrame:
    """``digests`` with ``repeats``: false for rows that have a bit of their own, and so a digest of their own."""
    bits = saved(shared_bits(digests), "shared-bits")
    return digests.join(F.broadcast(bits), "block", "left").select(
        "doc_id",
        "digest",
        "row",
        (F.col("bitmap").isNotNull() & F.forall(_probes("digest"), _bit_is_set)).alias("repeats"),
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after every run of ASCII white space
    became one space; a null text is an empty one. The row with the smallest id of
    a group stays. Among rows that repeat this id exactly one stays. Rows without
    an id come after all others: one stays only if its group has no id at all, and
    keep_id is then null. Other columns are not read. The Bloom filter has
    ``bits_per_row`` bits a row; at most ``broadcast_bytes`` of it are broadcast at a
    time, each to the digests of its own range. Results don't depend on either.
    """
    ready(docs.sparkSession)
    digests = saved(
        docs.select(
            F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normal_text(F.col(text_col)), 256)).alias("digest")
        ).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    blocks = max(1, ceil(digests.count() * bits_per_row / BLOCK_BITS))
    digests = digests.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)))
    together = max(1, broadcast_bytes * 8 // BLOCK_BITS)
    if blocks <= together:
        probed = _probed(digests)
    else:
        # Written once, a folder for each range; one range's filter is in memory at a time.
        ranged = digests.withColumn("span", F.floor(F.col("block") / together).cast("int"))
        ranges = saved(ranged, "digest-ranges", partition_by="span")
        spans = [ranges.filter(F.col("span") == k).drop("span") for k in range(ceil(blocks / together))]
        probed = reduce(DataFrame.unionByName, [saved(_probed(own), "probed") for own in spans])
    possible = probed.filter("repeats").select("doc_id", "digest", "row")
    groups = saved(
        possible.groupBy("digest").agg(
            F.min("doc_id").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            # Rows without an id win only where no row has one.
            F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"),
        ),
        "groups",
    )
    # Both sides are plain shuffles, so adaptive execution splits a digest that holds a third of the rows.
    grouped = possible.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest"
    )
    single = probed.filter("NOT repeats").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "digest",
    )
    return single.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
