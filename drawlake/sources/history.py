"""The history table: layout, scans, key lookup and append."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F

from drawlake.operators.rank import one_per_key
from drawlake.sources.known import MOST_LISTED, mark_known
from drawlake.session import written
from drawlake.spec import BONUS_COLUMNS, MAIN_COLUMNS, POOLS, check_pool, clean_type

KEYS = ["lottery_type", "draw_no"]

# Landing files are grouped by blocks of draw numbers, not one folder per draw.
LANDING_BLOCK = 100_000


def write_history(
    rows: DataFrame, path: str, *, mode: str = "append", unique: bool = True
) -> None:
    """Partitioned by pool, ordered by draw_no so that scans skip row groups.

    Rows with unique keys are also range-partitioned. Copies of one key would
    all meet in one range, so without ``unique`` rows stay where they are.
    """
    placed = rows.repartitionByRange("lottery_type", "draw_no") if unique else rows
    (
        placed.sortWithinPartitions(*KEYS)
        .write.mode(mode)
        .partitionBy("lottery_type")
        .parquet(path)
    )


def write_landing(rows: DataFrame, path: str) -> None:
    """Immutable landing layout, safe as the source of a file stream."""
    blocked = rows.withColumn("draw_block", F.floor(F.col("draw_no") / LANDING_BLOCK).cast("bigint"))
    (
        blocked.repartitionByRange("lottery_type", "draw_no")
        .write.mode("append")
        .partitionBy("lottery_type", "draw_block")
        .parquet(path)
    )


def write_latest(rows: DataFrame, path: str) -> None:
    """Replaceable landing of the newest draw of each pool; pools that ``rows`` lack keep what they have."""
    newest = batch_latest_row(rows.filter(F.col("draw_no").isNotNull()))
    writer = newest.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("lottery_type").parquet(path)


def overwrite_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def range_scan(
    history: DataFrame, lottery_type: str, min_target: int, max_target: int, limit: int
) -> DataFrame:
    """Draws that targets in a range may train on: projected columns of one pool,
    ``draw_no`` between the lowest target minus limit and margin, and the highest."""
    kind = check_pool(lottery_type)
    pool = POOLS[kind]
    low = max(1, min_target - limit - 50)
    return history.filter(
        (F.col("lottery_type") == kind) & F.col("draw_no").between(low, max_target)
    ).select(
        "lottery_type", "draw_no", "draw_date",
        *MAIN_COLUMNS[: pool.pick], *BONUS_COLUMNS[: pool.bonus], "source_url",
    )


def date_range_scan(history: DataFrame, start: str, end: str) -> DataFrame:
    """Draws between two ISO dates, inclusive."""
    if start > end:
        raise ValueError("the range ends before it starts")
    return history.filter(F.col("draw_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def of_type(rows: DataFrame, lottery_type: str) -> DataFrame:
    return rows.filter(clean_type("lottery_type") == check_pool(lottery_type))


def latest_n(history: DataFrame, limit: int, *order: str) -> DataFrame:
    """Newest rows by the given columns: a distributed top-k, no full sort."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    return history.orderBy(*[F.desc(c) for c in (order or ("draw_no",))]).limit(limit)


# Numbers of a stretch, and stretches that a scan is narrowed to; beyond, the closest ones join.
STRETCH = 32_768
MOST_STRETCHES = 64


def near_batch(history: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys of the history in the stretches of draw numbers that a batch touches, which prunes the scan.

    One far number in the batch adds its own stretch, not all numbers in between.
    Finding them takes an action over ``rows``, so they should be a written or cached batch.
    """
    found = (
        rows.filter(F.col("draw_no").isNotNull())
        .groupBy(F.floor(F.col("draw_no") / STRETCH).cast("bigint").alias("stretch"))
        .agg(F.min("draw_no").alias("low"), F.max("draw_no").alias("high"))
        .orderBy("stretch")
        .limit(MOST_LISTED + 1)
        .collect()
    )
    keys = history.select(*KEYS)
    if not found:
        return keys.filter(F.lit(False))
    if len(found) > MOST_LISTED:
        low, high = rows.agg(F.min("draw_no"), F.max("draw_no")).first()
        return keys.filter(F.col("draw_no").between(F.lit(low), F.lit(high)))
    spans = merged_spans([(r.low, r.high) for r in found], MOST_STRETCHES)
    return keys.filter(reduce(or_, [F.col("draw_no").between(F.lit(low), F.lit(high)) for low, high in spans]))


def merged_spans(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Ordered spans joined over their smallest gaps until at most ``most`` are left; adjoining stretches join anyway."""
    gaps = [b[0] - a[1] for a, b in zip(spans, spans[1:])]
    least = sorted(gaps, reverse=True)[most - 2] if len(gaps) >= most else 0
    out = [spans[0]]
    for gap, span in zip(gaps, spans[1:]):
        if gap <= STRETCH or gap < least or len(out) == most:
            out[-1] = (out[-1][0], span[1])
        else:
            out.append(span)
    return out


def existing_keys(history: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys of ``rows`` that the history already holds."""
    keys = rows.filter(F.col("draw_no").isNotNull()).select(*KEYS).distinct()
    return history.select(*KEYS).join(keys, KEYS, "left_semi")


def indexed_keys(index_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """The same from the bitmap index of the history (``known.lookup``), which is all that is read of it."""
    keys = rows.filter(F.col("draw_no").isNotNull()).select(*KEYS).distinct()
    return mark_known(keys, index_rows).filter("known").drop("known")


def indexed_new_rows(index_rows: DataFrame, rows: DataFrame, *, dedupe: bool = True) -> DataFrame:
    """Numbered rows whose key the bitmap index of the history lacks; copies as in ``new_rows``.

    The key decides, so known rows go before copies collapse: only new ones are sorted and shuffled.
    """
    fresh = mark_known(rows.filter(F.col("draw_no").isNotNull()), index_rows).filter(~F.col("known")).drop("known")
    return one_per_key(fresh, KEYS) if dedupe else fresh


def new_rows(history: DataFrame, rows: DataFrame, *, dedupe: bool = True) -> DataFrame:
    """Numbered rows whose key is not in the history: one anti join, nothing runs while it is planned.

    Copies inside the batch collapse to one row before any shuffle;
    ``dedupe=False`` keeps them.
    """
    numbered = rows.filter(F.col("draw_no").isNotNull())
    candidates = one_per_key(numbered, KEYS) if dedupe else numbered
    return candidates.join(history.select(*KEYS), KEYS, "left_anti")


def import_metrics(rows: DataFrame, inserted: DataFrame) -> DataFrame:
    """total / inserted / skipped per pool; skipped counts known and unnumbered rows."""
    total = rows.groupBy("lottery_type").agg(F.count(F.lit(1)).alias("total_rows"))
    added = inserted.groupBy("lottery_type").agg(F.count(F.lit(1)).alias("inserted_rows"))
    return (
        total.join(added, "lottery_type", "left")
        .withColumn("inserted_rows", F.coalesce("inserted_rows", F.lit(0)))
        .withColumn("skipped_rows", F.col("total_rows") - F.col("inserted_rows"))
    )


def batch_latest_row(rows: DataFrame) -> DataFrame:
    """Row with the largest draw_no per pool; a missing number counts as 0."""
    rest = [c for c in rows.columns if c != "lottery_type"]
    return (
        rows.groupBy("lottery_type")
        .agg(F.max_by(F.struct(*rest), F.coalesce("draw_no", F.lit(0))).alias("_row"))
        .select("lottery_type", "_row.*")
    )


def import_rows(
    spark: SparkSession, rows: DataFrame, path: str, *, dedupe: bool = True, check_existing: bool = True
) -> DataFrame:
    """Append the new rows of a batch to the history at ``path``; returns the metrics.

    ``check_existing=False`` is the bulk load without a key check. Metrics are
    taken from the rows as written, so they report the true insert count.
    """
    fresh = rows
    if check_existing:
        # The batch is read once here; its numbered rows, without copies, tell which part of the history is near.
        numbered = rows.filter(F.col("draw_no").isNotNull())
        batch = written(one_per_key(numbered, KEYS) if dedupe else numbered, "import-batch")
        fresh = new_rows(near_batch(spark.read.parquet(path), batch), batch, dedupe=False)
    # Fix the new rows in a staged table first: the append changes the history they depend on.
    staged = written(fresh, "import")
    write_history(staged, path, unique=dedupe and check_existing)
    return import_metrics(rows, staged)
