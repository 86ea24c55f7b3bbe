"""Backtest of a grid of targets x history limits x seeds as one plan.

Scores depend on target and limit only, so they are computed once and the
seeds are multiplied in afterwards. After the two shuffles of ranking and
chunking everything up to the judged run is narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from drawlake.functions.arrays import from_mask
from drawlake.operators.match import (
    judged_tickets, outcome_parts, ticket_keys, tier_label, ticket_structs,
)
from drawlake.operators.pin import pin
from drawlake.operators.rank import rank_draws
from drawlake.operators.scores import ScoreWeights
from drawlake.operators.sliding import window_features
from drawlake.operators.tickets import generate_tickets
from drawlake.spec import check_limits, check_ticket_count


def scored_targets(
    draws: DataFrame,
    *,
    series_cols: list[str],
    limits: list[int],
    targets: DataFrame | None = None,
    weights: ScoreWeights = ScoreWeights(),
    unique: bool = False,
) -> DataFrame:
    """Main and bonus scores of every (target draw, limit) with earlier draws.

    ``targets`` (series, draw_no) restricts the targets; without it every draw
    is one. Targets that do not exist are reported by ``missing_targets``.
    """
    ranked = rank_draws(draws, series_cols, unique=unique)
    target_col = None
    if targets is not None:
        target_col = "is_target"
        marked = targets.select(*series_cols, "draw_no").distinct().withColumn(target_col, F.lit(True))
        ranked = ranked.join(marked, [*series_cols, "draw_no"], "left").withColumn(
            target_col, F.coalesce(target_col, F.lit(False))
        )
    return window_features(
        ranked,
        series_cols,
        limits,
        keep=[c for c in ("lottery_type", "draw_no", "draw_date") if c not in series_cols],
        weights=weights,
        target_col=target_col,
    )


def missing_targets(draws: DataFrame, targets: DataFrame, series_cols: list[str]) -> DataFrame:
    return targets.join(draws, [*series_cols, "draw_no"], "left_anti")


def targets_without_history(draws: DataFrame, series_cols: list[str]) -> DataFrame:
    """First draw of each series: a target that no earlier draw can train."""
    return draws.groupBy(*series_cols).agg(F.min("draw_no").alias("draw_no"))


def run_grid(
    draws: DataFrame,
    *,
    series_cols: list[str],
    limits: list[int],
    seeds: list[int],
    count: int = 5,
    strategy: str = "mixed",
    targets: DataFrame | None = None,
    unique: bool = False,
) -> DataFrame:
    """One row per run: keys, target masks, tickets, ticket_masks, error.

    The profile strategies exist for the 7-pick pool only; as in a single
    evaluation, the 6-pick pool falls back to the default generator.
    """
    check_ticket_count(count)
    if not seeds:
        raise ValueError("at least one seed is required")
    scored = scored_targets(
        draws,
        series_cols=series_cols,
        limits=check_limits(limits),
        targets=targets,
        unique=unique,
    )
    seeds = sorted(set(seeds))
    if strategy == "second_prize_oriented":
        seven = F.col("lottery_type") == "loto7"
        return generate_tickets(scored.filter(seven), count=count, strategy=strategy, seeds=seeds).unionByName(
            generate_tickets(scored.filter(~seven), count=count, strategy="default", seeds=seeds)
        )
    return generate_tickets(scored, count=count, strategy=strategy, seeds=seeds)


def best_of_runs(runs: DataFrame) -> DataFrame:
    """Judge each run's tickets in place and keep its best ticket and prize flags.

    Best is the largest (points, main, bonus); equal triples have equal tiers.
    """
    # Keys are made once a run; the tickets themselves only where they are read.
    judged = pin(runs, _keys=ticket_keys())
    judged = pin(judged, best_key=F.coalesce(F.array_max("_keys"), F.lit(0)))
    parts = outcome_parts(F.col("best_key"))
    won = lambda tier: F.exists("_keys", lambda k: k % 10 == tier)
    return judged.select(
        *[c for c in runs.columns if c not in ("tickets", "ticket_masks")],
        F.size("tickets").alias("ticket_count"),
        "best_key",
        parts["main_match"].alias("best_main_match"),
        parts["bonus_match"].alias("best_bonus_match"),
        parts["near_miss_score"].alias("best_near_miss_score"),
        parts["prize_tier"].alias("best_tier"),
        won(1).alias("first_prize_found"),
        won(2).alias("second_prize_found"),
        ticket_structs().alias("judged"),
    )


def run_details(runs: DataFrame, *, count: int, strategy: str) -> DataFrame:
    """Nested result, one row per run, as written to JSON lines."""
    best = best_of_runs(runs)
    return best.select(
        *[c for c in best.columns if c in ("series", "lottery_type")],
        F.col("draw_no").alias("target_draw_no"),
        F.col("draw_date").cast("string").alias("target_draw_date"),
        from_mask(F.col("main_mask")).alias("target_main"),
        from_mask(F.col("bonus_mask")).alias("target_bonus"),
        "history_limit",
        "history_count",
        F.lit(count).alias("prediction_count"),
        F.lit(strategy).alias("strategy"),
        "seed",
        F.col("judged").alias("tickets"),
        "best_main_match",
        "best_bonus_match",
        tier_label(F.col("best_tier")).alias("best_prize"),
        "best_near_miss_score",
        "first_prize_found",
        "second_prize_found",
    )


__all__ = [
    "best_of_runs",
    "judged_tickets",
    "missing_targets",
    "run_details",
    "run_grid",
    "scored_targets",
    "targets_without_history",
]
