"""Score features of every training window, for all draws at once.

The training window of a target is the ``limit`` draws before it. Neighbouring
windows overlap almost fully, so counts come from running totals: the count in
a window is the difference of two totals, O(1) per target and number.

Series are cut into chunks of consecutive positions, so a dominant series spreads
over as many tasks as it has chunks. A chunk needs the totals at three places of
each of its targets: at the target, where its window begins, and where the recent
part of the window begins. Up to ``LONG_LIMIT`` it borrows all draws of its windows
from the chunks before. For longer limits it gets the totals that earlier chunks
carry over (prefix sums of one row per chunk, see ``prefix``), and only the draws
of the chunks in which those three places lie. A group holds some tens of
thousands of draws at any limit, two number masks each; counters exist for one
slice of ``SLICE`` draws at a time, and results leave slice by slice.

The running totals of 43 numbers x 3 counters as window functions need several
hundred window expressions in one plan. Measured on 150,000 draws, ranking
included, that took 10 to 14 s warm against 3.5 s with the small array helper
below, which Spark calls once per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from drawlake.functions.arrays import to_mask
from drawlake.functions.kernels import score_matrix
from drawlake.operators.prefix import carried_totals, number_bits
from drawlake.operators.scores import ScoreWeights, bonus_weights
from drawlake.operators.tickets import list_matrix
from drawlake.session import written
from drawlake.spec import MAX_NUMBER, check_limits

MIN_CHUNK = 1024
# Longer windows are not borrowed whole; their chunks have a fixed size.
LONG_LIMIT = 1 << 11
LONG_CHUNK = 1 << 13
SLICE = 1 << 13
COUNTS = T.ArrayType(T.IntegerType())
SCORES = T.ArrayType(T.DoubleType())
FEATURES = T.StructType(
    [T.StructField(name, COUNTS) for name in ("frequency", "recent", "idx")]
)


def chunk_size(limit: Column) -> Column:
    """Up to an eighth of a chunk is borrowed from its predecessor; fixed for long limits."""
    short = F.greatest(F.lit(MIN_CHUNK), limit * 8)
    return F.when(limit <= LONG_LIMIT, short).otherwise(LONG_CHUNK).cast("bigint")


def window_start(rk: Column, limit: Column) -> Column:
    """Position where the window of a target begins."""
    return rk - F.least(limit, rk - 1)


def recent_start(rk: Column, limit: Column) -> Column:
    """Position where the recent share of the window begins."""
    return rk - F.greatest(F.lit(1), F.floor(F.least(limit, rk - 1) * 3 / 10).cast("bigint"))


def _readers(rk: Column, limit: Column, place, about: Column) -> Column:
    """Chunks that read totals at a ``place`` of a chunk for which the draw at ``rk`` counts.

    They read from the start of the chunk that holds the place of their first target up
    to before the place of their last one. ``about`` is near the target whose place is rk.
    """
    near = F.floor((about - 1) / LONG_CHUNK).cast("bigint")

    def reads(chunk: Column) -> Column:
        first = place(F.greatest(chunk * LONG_CHUNK + 1, F.lit(2)), limit)
        last = place((chunk + 1) * LONG_CHUNK, limit)
        return (chunk >= 0) & (rk > F.floor((first - 1) / LONG_CHUNK) * LONG_CHUNK) & (rk < last)

    # No lambda: those are not compiled, and this runs for every draw.
    tried = F.array(*[F.when(reads(near + d), near + d) for d in range(-2, 4)])
    return F.array_except(tried, F.array(F.lit(None).cast("bigint")))


def chunks_of(rk: Column, limit: Column) -> Column:
    """Chunks in which a draw counts: its own, and those that borrow it."""
    size = chunk_size(limit)
    home = F.floor((rk - 1) / size).cast("bigint")
    short = F.when((rk - 1) % size >= size - limit, F.array(home, home + 1)).otherwise(F.array(home))
    # Places move forward by one draw per target, or by seven of ten while windows still grow.
    recent = F.least(F.floor(rk * 10 / 7), rk + F.floor(limit * 3 / 10)).cast("bigint")
    long = F.array_distinct(
        F.concat(F.array(home), _readers(rk, limit, window_start, rk + limit), _readers(rk, limit, recent_start, recent))
    )
    return F.when(limit <= LONG_LIMIT, short).otherwise(long)


def task_count(frame: DataFrame) -> int:
    """Explicit width for the compute-heavy stage.

    Its input is small per row but costly to process, so sizing tasks by bytes
    (as AQE coalescing would) leaves cores idle.
    """
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def window_features(
    ranked: DataFrame,
    series_cols: list[str],
    limits: list[int],
    *,
    keep: list[str] = (),
    pools: tuple[str, ...] = ("main", "bonus"),
    weights: ScoreWeights | None = None,
    target_col: str | None = None,
) -> DataFrame:
    """One row per (draw, limit) with at least one earlier draw.

    Output: series, rk, history_limit, history_count, main_mask, bonus_mask,
    the ``keep`` columns, and per pool a struct of arrays (frequency, recent,
    idx) indexed by number - 1; idx counts draws since the number was seen.
    With ``weights`` the finished scores come out instead (main_scores,
    bonus_scores), NULL for numbers outside the observed range of the window.

    ``target_col`` names a boolean column that marks the draws to evaluate;
    chunks without a marked draw are dropped before the shuffle.
    """
    limits = check_limits(limits)
    limit = F.col("history_limit")
    rk = F.col("rk")
    base = ranked.select(
        *series_cols,
        rk.cast("bigint").alias("rk"),
        to_mask(F.col("main_numbers")).alias("main_mask"),
        to_mask(F.col("bonus_numbers")).alias("bonus_mask"),
        *keep,
        (F.col(target_col) if target_col else F.lit(True)).alias("_is_target"),
    )
    long = [n for n in limits if n > LONG_LIMIT]
    if long:
        # Chunks, their targets and the totals all read the positions.
        base = written(base, "positions")
    draws = base.withColumn("history_limit", F.explode(F.array(*[F.lit(n).cast("bigint") for n in limits])))
    keys = [*series_cols, "history_limit", "_chunk"]
    home = F.floor((rk - 1) / chunk_size(limit)).cast("bigint")
    chunked = draws.withColumn("_home", home).withColumn("_chunk", F.explode(chunks_of(rk, limit)))
    # A series has no chunk beyond its last draw.
    if target_col or long:
        wanted = draws.filter("_is_target").select(*series_cols, "history_limit", home.alias("_chunk")).distinct()
        chunked = chunked.join(wanted, keys, "left_semi")
    chunked = chunked.withColumn("_place", F.lit(None).cast("string"))
    if long:
        totals = _totals_at_places(base, wanted.filter(F.col("history_limit") > LONG_LIMIT), series_cols, pools)
        chunked = chunked.unionByName(totals, allowMissingColumns=True)
        # Empty, not null: Spark's Arrow writer measures a batch at each row, and passes all nulls
        # since the last list again, which grows with the square of the batch.
        lists = [f.name for f in totals.schema.fields if isinstance(f.dataType, T.ArrayType)]
        chunked = chunked.withColumns({c: F.coalesce(c, F.array().cast(totals.schema[c].dataType)) for c in lists})
    carried = [*series_cols, "rk", "history_limit", "main_mask", "bonus_mask", *keep]
    schema = T.StructType(
        [draws.schema[c] for c in carried]
        + [T.StructField("history_count", T.LongType())]
        + [
            T.StructField(f"{pool}_features", FEATURES)
            if weights is None
            else T.StructField(f"{pool}_scores", SCORES)
            for pool in pools
        ]
    )
    per_pool = {"main": weights, "bonus": weights and bonus_weights(weights)}
    return chunked.groupBy(*keys).applyInArrow(
        chunk_counter(carried, {p: per_pool[p] for p in pools}, schema.names), schema
    )


PLACES = {"target": lambda rk, limit: rk, "window": window_start, "recent": recent_start}


def _totals_at_places(
    base: DataFrame, wanted: DataFrame, series_cols: list[str], pools: tuple[str, ...]
) -> DataFrame:
    """For each long chunk the totals carried into the chunks where its places begin: an equi-join on (series, chunk)."""
    rows = base.select(*series_cols, "rk", *[f"{p}_mask" for p in pools])
    totals = carried_totals(rows, series_cols, pools, LONG_CHUNK).withColumnRenamed("_chunk", "_from")
    first = F.greatest(F.col("_chunk") * LONG_CHUNK + 1, F.lit(2))
    begins = F.array(
        *[
            F.struct(
                F.lit(name).alias("_place"),
                F.floor((place(first, F.col("history_limit")) - 1) / LONG_CHUNK).cast("bigint").alias("_from"),
            )
            for name, place in PLACES.items()
        ]
    )
    asked = wanted.select(*series_cols, "history_limit", "_chunk", F.inline(begins))
    return asked.join(totals, [*series_cols, "_from"])


class _Totals:
    """Counts per number over all draws before given positions, which only move on.

    ``masks`` are those of the draws from position ``first`` on, ``carried`` the counts of the draws before.
    """

    def __init__(self, masks: np.ndarray, first: int, carried: np.ndarray | int = 0) -> None:
        self.masks, self.first, self.at = masks, first, 0
        self.total = np.zeros(MAX_NUMBER, np.int64) + carried

    def before(self, rk: np.ndarray) -> np.ndarray:
        rows = rk - self.first
        first, last = int(rows[0]), int(rows[-1])
        while self.at < first:
            stop = min(first, self.at + SLICE)
            self.total = self.total + number_bits(self.masks[self.at : stop]).sum(axis=0)
            self.at = stop
        steps = np.vstack([self.total, number_bits(self.masks[first:last])]).cumsum(axis=0)
        return steps[rows - first]


class _LastSeen:
    """Position of the latest draw before given positions that holds each number, 0 if none is known."""

    def __init__(self, masks: np.ndarray, first: int, carried: np.ndarray | int = 0) -> None:
        self.masks, self.first, self.at = masks, first, 0
        self.seen = np.zeros(MAX_NUMBER, np.int64) + carried

    def before(self, rk: np.ndarray) -> np.ndarray:
        while rk[0] - self.first - self.at > SLICE:
            self.before(np.array([self.first + self.at + SLICE]))
        first, last = self.at, int(rk[-1]) - self.first
        places = np.arange(first, last)[:, None] + self.first
        spots = number_bits(self.masks[first:last]) * places
        seen = np.maximum.accumulate(np.vstack([self.seen, spots]), axis=0)
        self.at, self.seen = last, seen[-1]
        return seen[rk - self.first - first]


def chunk_counter(
    carried: list[str], pools: dict[str, ScoreWeights | None], names: list[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts for the draws of one chunk; borrowed draws and carried totals only feed the totals."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        chunk = rows.filter(pc.is_null(rows["_place"])).sort_by("rk").combine_chunks()
        rk = chunk["rk"].to_numpy()
        if not len(rk):
            return
        limit = int(chunk["history_limit"][0].as_py())
        at_home = pc.equal(chunk["_home"], chunk["_chunk"]).to_numpy()
        own = np.flatnonzero(at_home & (rk > 1) & chunk["_is_target"].to_numpy())
        masks = {pool: chunk[f"{pool}_mask"].to_numpy() for pool in pools}
        at = {p["_place"]: p for p in rows.filter(pc.is_valid(rows["_place"])).to_pylist()}

        def reader(kind: type, pool: str, place: str, value: str):
            """Totals of a place, from the start of the chunk where it begins, or of all that is here."""
            if place not in at:
                return kind(masks[pool], int(rk[0]))
            first = at[place]["_from"] * LONG_CHUNK + 1
            return kind(masks[pool][np.searchsorted(rk, first) :], first, np.array(at[place][f"{pool}_{value}"]))

        totals = {pool: [reader(_Totals, pool, place, "count") for place in PLACES] for pool in pools}
        seen = {pool: reader(_LastSeen, pool, "target", "last") for pool in pools}
        for low in range(int(rk[own[0]]), int(rk[own[-1]]) + 1, SLICE) if len(own) else ():
            of_slice = own[np.searchsorted(rk[own], low) : np.searchsorted(rk[own], low + SLICE)]
            if not len(of_slice):
                continue
            targets = rk[of_slice]
            trained = np.minimum(limit, targets - 1)
            places = (targets, targets - trained, targets - np.maximum(1, trained * 3 // 10))
            columns = [chunk[c].take(pa.array(of_slice)).combine_chunks() for c in carried] + [pa.array(trained)]
            for pool, weights in pools.items():
                until, since, lately = (t.before(p) for t, p in zip(totals[pool], places))
                frequency, recent = until - since, until - lately
                idx = np.where(frequency > 0, targets[:, None] - 1 - seen[pool].before(targets), -1)
                if weights is None:
                    parts = [_lists(frequency), _lists(recent), _lists(idx, idx < 0)]
                    fields = [pa.field(n, pa.list_(pa.int32())) for n in FEATURES.names]
                    columns.append(pa.StructArray.from_arrays(parts, fields=fields))
                else:
                    scores = score_matrix(frequency, recent, idx, weights.__dict__)
                    columns.append(_lists(scores, np.isnan(scores), np.float64))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return count


def window_rankings(scored: DataFrame, *, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, ``ranking``: the numbers of each window by main score, then number,
    and the sums of both pools' scores. Numbers outside the window's range are left out."""
    schema = T.StructType(
        [scored.schema[c] for c in keep]
        + [T.StructField("ranking", COUNTS), T.StructField("main_total", T.DoubleType()), T.StructField("bonus_total", T.DoubleType())]
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main, bonus = (list_matrix(batch[f"{pool}_scores"]) for pool in ("main", "bonus"))
            # Missing scores sort last.
            order = (-main).argsort(axis=1, kind="stable") + 1
            sizes = (~np.isnan(main)).sum(axis=1)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            numbers = pa.array(order[np.arange(MAX_NUMBER) < sizes[:, None]].astype(np.int32))
            unscored = batch["main_scores"].is_null()
            ranking = pa.ListArray.from_arrays(ends, numbers, mask=unscored)
            totals = [pc.if_else(batch[f"{pool}_scores"].is_valid(), _sums(m), None) for pool, m in (("main", main), ("bonus", bonus))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), ranking, *totals], names=schema.names)

    return scored.select(*keep, "main_scores", "bonus_scores").mapInArrow(rank, schema)


def _sums(matrix: np.ndarray) -> pa.Array:
    """Row sums, added number by number as the row form does."""
    total = np.zeros(len(matrix))
    for column in np.nan_to_num(matrix, nan=0.0).T:
        total = total + column
    return pa.array(total)


def _lists(
    matrix: np.ndarray, missing: np.ndarray | None = None, dtype: type = np.int32
) -> pa.ListArray:
    """Matrix as a list column, one list per row."""
    offsets = np.arange(0, matrix.size + 1, MAX_NUMBER, dtype=np.int32)
    mask = None if missing is None else missing.ravel()
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel().astype(dtype), mask=mask))
