"""Sampling weights from number scores, row form, and the ticket profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from drawlake.functions.rounding import rank_key
from drawlake.functions.kernels import MIN_TEMPERATURE
from drawlake.spec import by_pool

# Fixed value: exponent of the default generator.
DEFAULT_TEMPERATURE = 0.85


@dataclass(frozen=True)
class Profile:
    """How one ticket of the profile generator mixes main and bonus scores."""

    name: str
    main_pool: int
    bonus_pool: int
    main_count: int
    bonus_count: int
    main_blend: tuple[float, float]
    bonus_blend: tuple[float, float]
    temperature: float


# The five ticket profiles of the 7-pick pool, in ticket order.
PROFILES = [
    Profile("main_hot", 18, 37, 6, 1, (0.94, 0.06), (0.30, 0.70), 0.75),
    Profile("main_balanced", 24, 37, 6, 1, (0.88, 0.12), (0.35, 0.65), 0.95),
    Profile("main_wide_bonus_hot", 30, 37, 6, 1, (0.82, 0.18), (0.22, 0.78), 1.05),
    Profile("main5_bonus2_balanced", 24, 37, 5, 2, (0.90, 0.10), (0.25, 0.75), 0.95),
    Profile("main5_bonus2_explore", 30, 37, 5, 2, (0.84, 0.16), (0.18, 0.82), 1.15),
]
# Fixed value: blend that orders the numbers of a profile ticket.
DISPLAY_BLEND = (0.75, 0.25)


def profile_name(lottery_type: Column, ticket_no: Column) -> Column:
    """Ticket label: profile names for the 7-pick pool, ``ticket_n`` otherwise."""
    case = F.when(lottery_type != "loto7", F.format_string("ticket_%d", ticket_no))
    for i, profile in enumerate(PROFILES, start=1):
        case = case.when(ticket_no == i, profile.name)
    return case.otherwise(F.format_string("profile_%d", ticket_no))


def clean_scores(scores: DataFrame) -> DataFrame:
    """Integer numbers with a non-negative score; NULL and negative scores are dropped."""
    return scores.withColumn("number", F.col("number").cast("int")).filter(
        F.col("number").isNotNull() & (F.col("score") >= 0)
    )


def pool_scores(scores: DataFrame, series_cols: list[str], *, order_col: str | None = None) -> DataFrame:
    """One row per number of the pool with its score over the series maximum.

    ``scores``: lottery_type, series, number, score. Of several scores for a number
    the one with the largest ``order_col`` counts (the last one), without that column
    the largest score. A series holds at most one row per number of its pool, so its
    map and window stay tiny.
    """
    scores = clean_scores(scores)
    last = F.max_by("score", order_col) if order_col else F.max("score")
    single = scores.groupBy(*series_cols, "lottery_type", "number").agg(last.alias("score"))
    per_series = single.groupBy(*series_cols, "lottery_type").agg(
        F.map_from_entries(F.collect_list(F.struct("number", "score"))).alias("by_number")
    )
    spine = per_series.withColumn(
        "number", F.explode(F.sequence(by_pool("lottery_type", "low"), by_pool("lottery_type", "high")))
    ).withColumn("score", F.coalesce(F.try_element_at("by_number", F.col("number")), F.lit(0.0)))
    top = F.max("score").over(Window.partitionBy(*series_cols))
    return spine.withColumn("scaled", F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0))).drop(
        "by_number"
    )


def with_weight(values: DataFrame, value: Column, temperature: Column, run_cols: list[str]) -> DataFrame:
    """Add ``weight`` = 1 + value ** temperature and its rank inside each run."""
    order = Window.partitionBy(*run_cols).orderBy(F.desc(rank_key(F.col("weight"))), F.asc("number"))
    power = F.greatest(F.lit(MIN_TEMPERATURE), temperature)
    return values.withColumn(
        "weight", F.lit(1.0) + F.pow(F.greatest(value, F.lit(0.0)), power)
    ).withColumn("weight_rank", F.row_number().over(order))


def base_weights(
    scores: DataFrame, series_cols: list[str], *, temperature: float = DEFAULT_TEMPERATURE
) -> DataFrame:
    return with_weight(
        pool_scores(scores, series_cols), F.col("scaled"), F.lit(temperature), series_cols
    ).select(*series_cols, "lottery_type", "number", "weight", "weight_rank")


def blended_weights(both: DataFrame, series_cols: list[str]) -> DataFrame:
    """Main and bonus sampling weights of every profile, one row per (series, profile, role, number).

    ``both`` holds the scores of the two roles (series, lottery_type, role, number, score).
    """
    rows = pool_scores(both, [*series_cols, "role"])
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("scaled")))
    left = rows.groupBy(*series_cols, "lottery_type", "number").agg(of("main").alias("m"), of("bonus").alias("b"))
    roles = [
        F.struct(
            F.lit(i).alias("profile_no"),
            F.lit(p.name).alias("profile"),
            F.lit(role).alias("role"),
            F.lit(blend[0]).alias("main_ratio"),
            F.lit(blend[1]).alias("bonus_ratio"),
            F.lit(p.temperature).alias("temperature"),
            F.lit(size).alias("pool_size"),
        )
        for i, p in enumerate(PROFILES, start=1)
        for role, blend, size in (
            ("main", p.main_blend, p.main_pool),
            ("bonus", p.bonus_blend, p.bonus_pool),
        )
    ]
    joined = (
        left.filter("m IS NOT NULL")
        .withColumn("_role", F.explode(F.array(*roles)))
        .select("*", "_role.*")
    )
    value = F.col("m") * F.col("main_ratio") + F.coalesce("b", F.lit(0.0)) * F.col("bonus_ratio")
    weighted = with_weight(
        joined, value, F.col("temperature"), [*series_cols, "profile_no", "role"]
    )
    return weighted.select(
        *series_cols, "profile_no", "profile", "role", "number", "weight", "weight_rank",
        (F.col("weight_rank") <= F.col("pool_size")).alias("in_pool"),
    )
