"""Number scores: frequency, recent share, recency, absence, repeat penalty."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from drawlake.functions.arrays import distinct_numbers


@dataclass(frozen=True)
class ScoreWeights:
    # Default weight of each component.
    frequency: float = 1.0
    recent: float = 2.0
    recency: float = 1.5
    absence: float = 0.8
    repeat_penalty: float = 0.4

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(float(v)) for k, v in self.__dict__.items()}


# Factors applied to the weights for bonus numbers.
BONUS_FACTORS = {
    "frequency": 0.9,
    "recent": 0.8,
    "recency": 1.0,
    "absence": 1.2,
    "repeat_penalty": 0.5,
}


def bonus_weights(weights: ScoreWeights) -> ScoreWeights:
    return replace(
        weights, **{k: getattr(weights, k) * factor for k, factor in BONUS_FACTORS.items()}
    )


def weighted_score(
    frequency: Column,
    max_frequency: Column,
    recent: Column,
    max_recent: Column,
    idx: Column,
    max_idx: Column,
    weights: dict[str, Column],
) -> Column:
    """Score of one number; ``idx`` (draws since last seen) is NULL if never seen.

    The terms are added in a fixed order so that equal inputs give equal bits.
    """
    age = idx.cast("double") / max_idx.cast("double")
    total = (
        frequency.cast("double") / max_frequency.cast("double") * weights["frequency"]
        + recent.cast("double") / max_recent.cast("double") * weights["recent"]
        + F.coalesce(F.lit(1.0) - age, F.lit(0.0)) * weights["recency"]
        + F.coalesce(F.least(age, F.lit(1.0)), F.lit(1.0)) * weights["absence"]
        - F.when(idx == 0, F.lit(1.0)).otherwise(F.lit(0.0)) * weights["repeat_penalty"]
    )
    return F.greatest(total, F.lit(0.0))


def number_scores(
    positioned: DataFrame,
    series_cols: list[str],
    *,
    numbers_col: str = "main_numbers",
    weights: ScoreWeights | dict[str, Column] = ScoreWeights(),
) -> DataFrame:
    """Score every number between the smallest and largest one seen in a series.

    ``positioned`` carries ``draw_idx`` and ``series_size`` (see ``rank``).
    Output: series, number, score. The per-number counts are combined on the
    map side, so a dominant series costs no extra shuffle.
    """
    recent_size = F.greatest(
        F.lit(1), F.floor(F.col("series_size") * F.lit(0.3)).cast("bigint")
    )
    seen = positioned.select(
        *series_cols,
        "draw_idx",
        (F.col("draw_idx") < recent_size).alias("is_recent"),
        F.explode(distinct_numbers(F.col(numbers_col))).alias("number"),
    )
    counts = seen.groupBy(*series_cols, "number").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.count_if(F.col("is_recent")).alias("recent"),
        F.min("draw_idx").alias("idx"),
    )
    # At most one entry per number of the pool, so the map of a series stays tiny.
    per_series = counts.groupBy(*series_cols).agg(
        F.max("frequency").alias("max_frequency"),
        F.greatest(F.max("recent"), F.lit(1)).alias("max_recent"),
        F.greatest(F.max("idx"), F.lit(1)).alias("max_idx"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.map_from_entries(
            F.collect_list(F.struct("number", F.struct("frequency", "recent", "idx")))
        ).alias("seen"),
    )
    filled = per_series.withColumn("number", F.explode(F.sequence("low", "high"))).withColumn(
        "count_of", F.try_element_at("seen", F.col("number"))
    )
    zero = F.lit(0)
    return filled.select(
        *series_cols,
        "number",
        weighted_score(
            F.coalesce("count_of.frequency", zero),
            F.col("max_frequency"),
            F.coalesce("count_of.recent", zero),
            F.col("max_recent"),
            F.col("count_of.idx"),
            F.col("max_idx"),
            weights if isinstance(weights, dict) else weights.columns(),
        ).alias("score"),
    )


def main_scores(
    positioned: DataFrame, series_cols: list[str], weights: ScoreWeights = ScoreWeights()
) -> DataFrame:
    return number_scores(positioned, series_cols, weights=weights)


def bonus_scores(
    positioned: DataFrame, series_cols: list[str], weights: ScoreWeights = ScoreWeights()
) -> DataFrame:
    return number_scores(
        positioned, series_cols, numbers_col="bonus_numbers", weights=bonus_weights(weights)
    )


def role_scores(
    positioned: DataFrame, series_cols: list[str], weights: ScoreWeights = ScoreWeights()
) -> DataFrame:
    """Main and bonus scores of one pass over the draws: series, role (main or bonus), number, score."""
    roles = [F.struct(F.lit(r).alias("role"), F.col(f"{r}_numbers").alias("numbers")) for r in ("main", "bonus")]
    tagged = positioned.select(*series_cols, "draw_idx", "series_size", F.inline(F.array(*roles)))
    main, bonus = weights.columns(), bonus_weights(weights).columns()
    by_role = {k: F.when(F.col("role") == "main", main[k]).otherwise(bonus[k]) for k in main}
    return number_scores(tagged, [*series_cols, "role"], numbers_col="numbers", weights=by_role)


def blended_roles(both: DataFrame, series_cols: list[str], *, main_weight: float = 0.8, bonus_weight: float = 0.2) -> DataFrame:
    """Weighted sum of the two roles' scores per number; a missing score counts as 0."""
    if main_weight < 0 or bonus_weight < 0:
        raise ValueError("blend weights below zero are not allowed")
    of = lambda role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("score"))), F.lit(0.0))
    score = of("main") * F.lit(float(main_weight)) + of("bonus") * F.lit(float(bonus_weight))
    return both.groupBy(*series_cols, "number").agg(score.alias("score"))


def combined_scores(
    main: DataFrame,
    bonus: DataFrame,
    series_cols: list[str],
    *,
    main_weight: float = 0.8,
    bonus_weight: float = 0.2,
) -> DataFrame:
    """Weighted sum over the union of numbers; a missing score counts as 0."""
    if main_weight < 0 or bonus_weight < 0:
        raise ValueError("blend weights below zero are not allowed")
    left = main.withColumnRenamed("score", "main_score")
    right = bonus.withColumnRenamed("score", "bonus_score")
    return left.join(right, [*series_cols, "number"], "full_outer").select(
        *series_cols,
        "number",
        (
            F.coalesce("main_score", F.lit(0.0)) * F.lit(float(main_weight))
            + F.coalesce("bonus_score", F.lit(0.0)) * F.lit(float(bonus_weight))
        ).alias("score"),
    )


def rank_scores(scores: DataFrame, series_cols: list[str]) -> DataFrame:
    """Position of each number by score, ties by number (a pool-sized window)."""
    order = Window.partitionBy(*series_cols).orderBy(F.desc("score"), F.asc("number"))
    return scores.withColumn("score_rank", F.row_number().over(order))
