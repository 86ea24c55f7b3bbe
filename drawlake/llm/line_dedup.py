"""Line dedup: overlapping three-line windows, found globally, merged into removed lines.

Windows are hashed and counted with DataFrame functions; counts combine before they
shuffle. Only windows that occur twice or more go back to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered_rows, ready, saved


def line_windows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, start and the 128-bit hash (h1, h2) of every ``width`` consecutive lines; ``docs`` has doc_id, text."""
    lines = docs.select("doc_id", F.split(F.col("text"), "\n", -1).alias("lines")).filter(F.size("lines") >= width)
    window = F.slice("lines", F.col("start") + 1, width)
    return (
        lines.select("doc_id", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - width)).alias("start"))
        .select("doc_id", "start", window.alias("window"))
        .select(
            "doc_id",
            "start",
            F.xxhash64("window").alias("h1"),
            F.xxhash64(F.lit(width), F.array_join("window", "\n")).alias("h2"),
        )
    )


def _kept_lines(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, removed, kept = [], [], []
            for text, starts in zip(batch["text"], batch["starts"]):
                text, starts = text.as_py(), starts.as_py()
                own = text.split("\n") if text else []
                stays = [True] * len(own)
                for start in starts or ():
                    stays[start : start + width] = [False] * width
                lines.append(len(own))
                removed.append(len(own) - sum(stays))
                kept.append("\n".join(compress(own, stays)) if starts else text or "")
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(lines, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                    *batch.columns[3:],
                ],
                ["doc_id", "n_lines", "n_removed", "kept", *batch.schema.names[3:]],
            )

    return run


def remove_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    carry: list[str | Column] | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept (the text without the removed lines).

    Lines are parted at line feeds and compared as they are. A window is ``width``
    consecutive lines of one row's text. Every line of a window that also starts earlier
    (smaller id, or earlier in the text) is removed; windows are judged on the input, and
    covered lines merge. Null and empty texts have no line, shorter texts no window; both
    stay as they are, null as empty. Ids are whole numbers. Rows that repeat an id are
    rows of their own, ordered by a hash of the text; of rows alike in both one is the
    first. Rows without an id stay whole and are earlier than nothing. Of other columns
    only ``carry`` is read: it comes out beside each row, in the struct ``carried``.
    """
    ready(docs.sparkSession)
    # The row number takes the place of the id: it keeps its order and is unique.
    table = numbered_rows(docs, id_col, text_col, carry)
    windows = line_windows(table.filter("doc_id IS NOT NULL").select(F.col("row").alias("doc_id"), "text"), width)
    # First the places within a row, then the rows: both minima are plain numbers.
    inside = windows.groupBy("h1", "h2", "doc_id").agg(
        F.min("start").alias("start"), F.count(F.lit(1)).alias("n")
    )
    firsts = saved(
        inside.groupBy("h1", "h2")
        .agg(
            F.min("doc_id").alias("first_doc"),
            F.min_by("start", "doc_id").alias("first_start"),
            F.sum("n").alias("n"),
        )
        .filter("n > 1")
        .drop("n"),
        "repeated-windows",
    )
    # A window of a third of all rows is split here: both sides are plain shuffles.
    repeats = windows.join(firsts, ["h1", "h2"]).filter(
        (F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start"))
    )
    starts = saved(
        repeats.groupBy(F.col("doc_id").alias("row")).agg(F.collect_set("start").alias("starts")), "line-removals"
    )
    # Always a shuffle by row: a broadcast that holds for small tables only would hide what large ones cost.
    joined = table.join(starts.hint("merge"), "row", "left")
    given = joined.select("doc_id", "text", "starts", *(["carried"] if carry else []))
    number = F.lit(0).cast("bigint")
    out = {"n_lines": number, "n_removed": number, "kept": F.lit("")}
    schema = given.select("doc_id", *[c.alias(n) for n, c in out.items()], *(["carried"] if carry else [])).schema
    return given.mapInArrow(_kept_lines(width), schema)
