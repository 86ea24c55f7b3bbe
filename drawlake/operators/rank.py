"""Dense draw positions inside a series without a per-series sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from drawlake.session import written

# A bucket spans this many draw numbers, hence at most this many rows once
# draw numbers are unique inside a series. Draw numbers are counters, so a
# bucket is also well filled; numbering with wide gaps is ranked as ``sparse``.
BUCKET_SPAN = 1 << 18
# Row number inside a task's part of monotonically_increasing_id.
ROW_BITS = 33


def one_per_key(draws: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """One row per key; copies collapse before the shuffle.

    With ``newest`` the row with the largest value of that column wins,
    otherwise the largest row by value; both are deterministic. A whole row as
    aggregate buffer makes Spark sort each partition by key; that is accepted,
    because ties need all columns to be broken the same way every time.
    """
    rest = [c for c in draws.columns if c not in keys]
    order = [newest, *[c for c in rest if c != newest]] if newest else rest
    packed = draws.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_row"))
    return packed.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def rank_draws(
    draws: DataFrame,
    series_cols: list[str],
    *,
    order_col: str = "draw_no",
    unique: bool = False,
    span: int = BUCKET_SPAN,
    sparse: bool = False,
) -> DataFrame:
    """Add ``rk`` (1 = oldest), ``series_size`` and ``draw_idx`` (0 = newest).

    A window over a whole series would put a dominant series into one task.
    Here rows are counted per draw-number bucket, the few bucket counts become
    running offsets, and only the rows of one bucket are ever sorted together.

    ``unique`` states that (series, order_col) has no duplicates; otherwise
    copies are removed first. Rows without an order value have no position and
    are left out. ``sparse`` is for order values with wide or uneven gaps, hashes
    for instance, of which fixed buckets would hold a row or so each.
    """
    base = draws if unique else one_per_key(draws, [*series_cols, order_col])
    if sparse:
        return _ranked_by_range(base, series_cols, order_col)
    return _ranked(base, series_cols, order_col, span)


def _ranked(base: DataFrame, series_cols: list[str], order_col: str, span: int, newest: int | None = None) -> DataFrame:
    """Positions inside the series; with ``newest`` only of rows in buckets that may hold that many newest ones."""
    base = base.withColumn("_bucket", F.floor(F.col(order_col) / F.lit(span)).cast("bigint"))
    offsets = _bucket_offsets(base.select(*series_cols, "_bucket"), series_cols)
    if newest is not None:
        offsets = offsets.filter(F.col("series_size") - F.col("_before") - F.col("_n") < newest)
    inside = Window.partitionBy(*series_cols, "_bucket").orderBy(order_col)
    return (
        base.join(offsets.drop("_n"), [*series_cols, "_bucket"])
        .withColumn("rk", F.col("_before") + F.row_number().over(inside))
        .withColumn("draw_idx", F.col("series_size") - F.col("rk"))
        .drop("_bucket", "_before")
    )


def _ranked_by_range(base: DataFrame, series_cols: list[str], order_col: str) -> DataFrame:
    """Positions from sampled splitters: rows are dealt to tasks by range, whatever the values.

    Ranges hold about equal numbers of rows and are sorted where they are. One count per
    series and range becomes the running offset, so a window spans as many rows as there
    are tasks. The ranges are written, because both the counts and the rows read them.
    """
    order = [*series_cols, order_col]
    dealt = base.filter(F.col(order_col).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_part", F.shiftright("_place", ROW_BITS))
    counts = placed.groupBy(*series_cols, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    series = Window.partitionBy(*series_cols)
    earlier = series.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *series_cols,
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(series).alias("series_size"),
    )
    return (
        placed.join(offsets, [*series_cols, "_part"])
        .withColumn("rk", F.col("_before") + F.col("_place") - F.col("_first") + 1)
        .withColumn("draw_idx", F.col("series_size") - F.col("rk"))
        .drop("_part", "_place", "_first", "_before")
    )


def _bucket_offsets(keys: DataFrame, series_cols: list[str]) -> DataFrame:
    """Rows before each bucket, and rows per series, from one count per bucket.

    The window holds one small row per bucket: a series of 10**12 draws has
    four million of them, which one task sorts in seconds.
    """
    counts = keys.groupBy(*series_cols, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    series = Window.partitionBy(*series_cols)
    earlier = series.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *series_cols,
        "_bucket",
        "_n",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(series).alias("series_size"),
    )


def latest_per_series(
    draws: DataFrame, series_cols: list[str], limit: int, *, order_col: str = "draw_no", span: int = BUCKET_SPAN
) -> DataFrame:
    """Newest ``limit`` draws of each series; rows without an order value are older than all others and left out.

    Bucket counts tell which draw-number buckets can hold the newest draws. Only
    those are joined and sorted, each by itself, whatever the limit: no series
    meets in one task.
    """
    known = draws.filter(F.col(order_col).isNotNull())
    newest = _ranked(known, series_cols, order_col, span, limit).filter(F.col("draw_idx") < limit)
    # Positions count inside the newest draws.
    size = F.least(F.col("series_size"), F.lit(limit).cast("bigint"))
    return newest.withColumn("series_size", size).withColumn("rk", F.col("series_size") - F.col("draw_idx"))
