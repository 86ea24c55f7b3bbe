"""Summaries of a backtest grid. Each is one aggregation with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from drawlake.operators.match import outcome_key, outcome_parts, tier_label
from drawlake.spec import TIER_LABELS

TOP_ROWS = 30


def prize_counts(tickets: DataFrame, scope: list[str]) -> DataFrame:
    """Tickets per tier, zero-filled, in tier order with "no prize" last."""
    counted = tickets.groupBy(*scope).agg(
        *[F.count_if(F.col("prize_tier") == tier).alias(f"t{tier}") for tier in TIER_LABELS]
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(label).alias("prize"), F.col(f"t{tier}").alias("tickets")
        )
        for i, (tier, label) in enumerate(TIER_LABELS.items(), start=1)
    ]
    return counted.select(*scope, F.inline(F.array(*rows)))


def group_summary(runs: DataFrame, scope: list[str]) -> DataFrame:
    """Runs summarised by target, by history limit and by seed in one pass."""
    by_target = F.col("draw_no").alias("target_draw_no")
    keys = runs.select(
        *scope, by_target, "history_limit", "seed", "first_prize_found", "second_prize_found",
        "best_near_miss_score", "best_key",
    )
    sets = [[*scope, "target_draw_no"], [*scope, "history_limit"], [*scope, "seed"]]
    grouped = keys.groupingSets(
        [[F.col(c) for c in s] for s in sets], *scope, "target_draw_no", "history_limit", "seed"
    ).agg(
        F.grouping("target_draw_no").alias("_no_target"),
        F.grouping("history_limit").alias("_no_limit"),
        F.count(F.lit(1)).alias("runs"),
        F.count_if("first_prize_found").alias("first_runs"),
        F.count_if("second_prize_found").alias("second_runs"),
        F.max("best_key").alias("best_key"),
        F.avg("best_near_miss_score").alias("avg_best_score"),
    )
    best = outcome_parts(F.col("best_key"))
    return grouped.select(
        *scope,
        F.when(F.col("_no_target") == 0, "target")
        .when(F.col("_no_limit") == 0, "history_limit")
        .otherwise("seed")
        .alias("grouping"),
        F.coalesce("target_draw_no", "history_limit", "seed").alias("group_key"),
        "runs",
        "first_runs",
        "second_runs",
        best["main_match"].alias("best_main_match"),
        best["bonus_match"].alias("best_bonus_match"),
        tier_label(best["prize_tier"]).alias("best_prize"),
        "avg_best_score",
    )


def ticket_summary(tickets: DataFrame, scope: list[str]) -> DataFrame:
    """Per ticket number and profile: tier counts, best match, average points."""
    key = outcome_key(
        F.col("near_miss_score"), F.col("main_match"), F.col("bonus_match"), F.col("prize_tier")
    )
    best = outcome_parts(F.col("best_key"))
    grouped = tickets.groupBy(*scope, "ticket_no", "profile_name").agg(
        F.count(F.lit(1)).alias("tickets"),
        *[F.count_if(F.col("prize_tier") == t).alias(f"tier_{t}") for t in range(1, 7)],
        F.max(key).alias("best_key"),
        F.avg("near_miss_score").alias("avg_score"),
    )
    return grouped.select(
        *scope,
        "ticket_no",
        "profile_name",
        "tickets",
        *[f"tier_{t}" for t in range(1, 7)],
        best["main_match"].alias("best_main_match"),
        best["bonus_match"].alias("best_bonus_match"),
        "avg_score",
    )


def batch_totals(runs: DataFrame, scope: list[str]) -> DataFrame:
    return (
        runs.groupBy(*scope)
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.sum("ticket_count").alias("total_tickets"),
            F.count_if("first_prize_found").alias("first_prize_runs"),
            F.count_if("second_prize_found").alias("second_prize_runs"),
        )
        .withColumn("second_prize_rate", F.try_divide("second_prize_runs", "total_runs"))
    )


def _ranked_top(rows: DataFrame, order: list[Column]) -> DataFrame:
    """First rows in ``order`` with their rank; only the kept rows meet in one task."""
    top = rows.orderBy(*order).limit(TOP_ROWS)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_runs(runs: DataFrame) -> DataFrame:
    """Best 30 runs; equal runs keep grid order (target, limit, seed)."""
    order = [
        F.desc("first_prize_found"),
        F.desc("second_prize_found"),
        F.desc("best_near_miss_score"),
        F.desc("best_main_match"),
        F.desc("best_bonus_match"),
        F.asc("draw_no"),
        F.asc("history_limit"),
        F.asc("seed"),
    ]
    return _ranked_top(runs, order).select(
        "rank",
        F.col("draw_no").alias("target_draw_no"),
        "history_limit",
        "seed",
        "best_main_match",
        "best_bonus_match",
        tier_label(F.col("best_tier")).alias("best_prize"),
        "best_near_miss_score",
        "first_prize_found",
        "second_prize_found",
    )


def hit_examples(tickets: DataFrame) -> DataFrame:
    """Best 30 tickets among those in the first three tiers."""
    order = [
        F.desc("near_miss_score"),
        F.desc("main_match"),
        F.desc("bonus_match"),
        F.asc("draw_no"),
        F.asc("history_limit"),
        F.asc("seed"),
        F.asc("ticket_no"),
    ]
    hits = tickets.filter(F.col("prize_tier").isin(1, 2, 3))
    return _ranked_top(hits, order).select(
        "rank",
        F.col("draw_no").alias("target_draw_no"),
        "history_limit",
        "seed",
        "ticket_no",
        "profile_name",
        "main_match",
        "bonus_match",
        tier_label(F.col("prize_tier")).alias("prize"),
        "prediction",
    )
