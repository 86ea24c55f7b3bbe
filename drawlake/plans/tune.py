"""Tuning of score weights by backtest over a fixed grid, for all series at once.

The counts behind a score do not depend on the weights, so they are taken once
per (series, round) and only the weighting is repeated for each grid point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from drawlake.functions.arrays import overlap
from drawlake.functions.kernels import score_matrix
from drawlake.operators.rank import latest_per_series
from drawlake.operators.scores import ScoreWeights
from drawlake.operators.sliding import SCORES, _lists, window_features
from drawlake.operators.tickets import generate_tickets, list_matrix
from drawlake.spec import check_limits, check_ticket_count

# The grid, in search order.
GRID = list(
    product((0.8, 0.9, 1.0, 1.2), (0.5, 1.0, 1.5, 2.0, 2.8), (1.0, 1.5, 2.0))
)
WEIGHT_COLUMNS = ["frequency", "recent", "recency", "absence", "repeat_penalty"]


def min_training(history_limit: int) -> int:
    return min(80, max(40, history_limit // 2))


def score_features(features: DataFrame, feature_col: str, out_col: str) -> DataFrame:
    """Replace a feature struct by scores, using the row's own weight columns."""
    kept = [f for f in features.schema.fields if f.name != feature_col]
    schema = T.StructType([*kept, T.StructField(out_col, SCORES)])
    return features.mapInArrow(_scorer(feature_col, [f.name for f in kept], schema.names), schema)


def _scorer(
    feature_col: str, kept: list[str], names: list[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch[feature_col].flatten()
            frequency, recent, idx = (list_matrix(p) for p in parts)
            weights = {c: batch[c].to_numpy()[:, None] for c in WEIGHT_COLUMNS}
            scores = score_matrix(frequency, recent, np.nan_to_num(idx, nan=-1.0), weights)
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in kept], _lists(scores, np.isnan(scores), np.float64)],
                names=names,
            )

    return score


def tune_weights(
    draws: DataFrame,
    *,
    series_cols: list[str],
    history_limit: int = 100,
    count: int = 5,
    backtest_rounds: int | None = None,
    min_train_draws: int | None = None,
    latest: DataFrame | None = None,
) -> DataFrame:
    """Best grid point of each series over its newest draws.

    Every round predicts one draw from all older draws of the history, with
    the default generator seeded by the round. A series too short for one
    round keeps the default weights with score 0 and 0 rounds.
    ``backtest_rounds`` and ``min_train_draws`` replace the defaults, a tenth of the
    history (8 to 20) and half the limit (40 to 80). ``latest`` are the newest draws
    of each series, if the caller has them already.
    Output: series, frequency, recent, recency, optimizer_score, optimizer_rounds.
    """
    check_limits([n for n in (history_limit, backtest_rounds, min_train_draws) if n is not None])
    check_ticket_count(count)
    least_training = min_train_draws or min_training(history_limit)
    if latest is None:
        latest = latest_per_series(draws, series_cols, history_limit)
    extra = [c for c in ("lottery_type",) if c not in series_cols]
    features = window_features(
        latest, series_cols, [history_limit], keep=[*extra, "series_size"], pools=("main",)
    )
    size = F.col("series_size")
    rounds = F.least(F.lit(20), F.greatest(F.lit(8), F.floor(size / 10).cast("bigint")))
    if backtest_rounds is not None:
        rounds = F.lit(backtest_rounds)
    offset = size - F.col("rk")
    evaluated = features.filter(
        (offset < rounds)
        & (F.col("history_count") >= least_training)
        & (size > least_training + 1)
    )
    defaults = ScoreWeights()
    points = F.array(
        *[
            F.struct(
                F.lit(i).alias("grid_id"),
                F.lit(f).alias("frequency"),
                F.lit(r).alias("recent"),
                F.lit(y).alias("recency"),
                F.lit(defaults.absence).alias("absence"),
                F.lit(defaults.repeat_penalty).alias("repeat_penalty"),
            )
            for i, (f, r, y) in enumerate(GRID)
        ]
    )
    grid = evaluated.select(
        *series_cols, *extra, "main_mask", "main_features", offset.alias("seed"), F.inline(points)
    )
    scored = score_features(grid, "main_features", "main_scores")
    runs = generate_tickets(scored, count=count, strategy="default")
    best_match = F.array_max(
        F.transform("ticket_masks", lambda m: overlap(m, F.col("main_mask")))
    )
    fitness = (
        runs.withColumn("best_match", best_match)
        .groupBy(*series_cols, "grid_id", "frequency", "recent", "recency")
        .agg(F.avg("best_match").alias("score"), F.count(F.lit(1)).alias("rounds"))
    )
    # Largest score; among equals the earliest grid point.
    best = fitness.groupBy(*series_cols).agg(
        F.max_by(
            F.struct("frequency", "recent", "recency", "score", "rounds"),
            F.struct(F.col("score"), -F.col("grid_id")),
        ).alias("best")
    )
    return (
        latest.select(*series_cols)
        .distinct()
        .join(best, series_cols, "left")
        .select(
            *series_cols,
            *[
                F.coalesce(f"best.{w}", F.lit(getattr(defaults, w))).alias(w)
                for w in ("frequency", "recent", "recency")
            ],
            F.coalesce("best.score", F.lit(0.0)).alias("optimizer_score"),
            F.coalesce("best.rounds", F.lit(0)).alias("optimizer_rounds"),
        )
    )
