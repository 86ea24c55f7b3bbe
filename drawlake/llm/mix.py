"""Mixing sources to target weights: systematic sampling over prefix sums.

Every source has a target share of all words. Inside a source each document
expects target / size copies of itself; these expectations are added up in order
of document size, one random offset per source is added, and a document comes out
once for each whole number that its stretch of the sum passes. Documents of like
size follow each other, so the words taken differ from the target by no more than
the longest document has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, saved, utf8, word_bounds

# Expected copies are whole multiples of 1 / UNIT, so that sums are exact in any order.
UNIT = 1 << 30
# Row number inside a task's part of monotonically_increasing_id.
ROW_BITS = 33


def _word_counts(batches):
    for batch in batches:
        _, _, words = word_bounds(*utf8(batch.column("text")))
        columns = [batch.column("doc_id"), batch.column("source"), pa.array(np.diff(words), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "size"])


def document_sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """doc_id, source and number of words of every row; a null text has none."""
    picked = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).cast("string").alias("text")
    )
    schema = picked.drop("text").withColumn("size", F.lit(0).cast("bigint")).schema
    return picked.mapInArrow(_word_counts, schema)


def numbered(frame: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``frame`` with ``number``, its place in the whole order, from 0.

    Rows are dealt to tasks by range and sorted there; the rows of earlier tasks are
    added from one count per task. No window spans more than these counts.
    """
    placed = saved(
        frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftright("place", ROW_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    # One row per task of the exchange: bounded by the number of shuffle partitions.
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(before), "part")
        .withColumn("number", F.col("before") + F.col("place").bitwiseAND((1 << ROW_BITS) - 1))
        .drop("part", "place", "before")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Words each source should give: source, source_size, target.

    Sources in code point order, null last, take ``weights`` in turn and share all
    words by them. No target exceeds ``most`` times the source's size; what is above
    goes to the others by weight until none is above. Each round is one aggregate
    over the sources, which only the level of a share per weight leaves.
    """
    totals = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    cycle = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    sources = saved(
        numbered(totals, [F.col("source").asc_nulls_last()], "sources").select(
            "source",
            "source_size",
            F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int")).alias("weight"),
        ),
        "weights",
    )
    limit = most * F.col("source_size")
    level, closed = 0.0, -1
    while True:
        full = limit <= F.lit(level) * F.col("weight") if closed >= 0 else F.lit(False)
        row = sources.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(full, limit)).alias("given"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("closed"),
        ).first()
        if not row["open"] or row["closed"] == closed:
            break
        level, closed = (row["words"] - (row["given"] or 0)) / row["open"], row["closed"]
    return sources.select(
        "source",
        "source_size",
        F.least(limit.cast("double"), F.lit(level) * F.col("weight")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``size`` is the number of words (runs of bytes other than ASCII white space), 0 for
    a null text; ``copies`` says how often the mix takes the document and ``taken`` how
    many words that are. A document is taken at most ``most`` times, because no source
    has more expected copies per document. Rows of a null source are a source of their
    own. Documents without words neither count nor give anything, but keep their row.
    The offset of a source comes from ``seed`` and its name, ties of size are ordered by
    id, null last, so a rerun agrees; rows that repeat an id and a size are exchangeable.
    An empty table gives an empty result. Other columns are not read.
    """
    ready(docs.sparkSession)
    # The row number only parts rows that are alike, so that no id can fill one task.
    sizes = saved(
        document_sizes(docs, id_col, source_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sizes"
    )
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranked = numbered(sizes, order, "ranked").drop("row")
    first = ranked.groupBy("source").agg(F.min("number").alias("first"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    offset = (F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("bigint") * (UNIT >> 28)).alias("offset")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0)
    plan = (
        source_targets(sizes, weights, most)
        .join(first.withColumnRenamed("source", "other"), F.col("source").eqNullSafe(F.col("other")))
        .select("other", "source_size", "target", "first", offset, rate.cast("bigint").alias("rate"))
    )

    def passed(place: str) -> Column:
        return F.expr(
            f"(CAST(offset AS DECIMAL(10, 0)) + CAST(rate AS DECIMAL(10, 0)) * CAST({place} AS DECIMAL(18, 0))) DIV {UNIT}"
        )

    copies = passed("number - first + 1") - passed("number - first")
    return (
        ranked.join(plan, F.col("source").eqNullSafe(F.col("other")))
        .withColumn("copies", copies)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)).alias("copies"),
            (F.col("size") * F.col("copies")).alias("taken"),
        )
    )


def emissions(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix_sources`` as often as the mix takes them, numbered from 1 in ``copy``."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
