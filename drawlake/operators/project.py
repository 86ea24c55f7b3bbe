"""Conversions between the array form and the wide n1..n7, b1, b2 form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from drawlake.functions.arrays import (
    bonus_from_wide, main_from_wide, wide_bonus, wide_main,
)
from drawlake.operators.pin import pin
from drawlake.spec import BONUS_COLUMNS, MAIN_COLUMNS, by_pool, clean_type, is_known_type

WIDE_NUMBERS = [*MAIN_COLUMNS, *BONUS_COLUMNS]


def to_wide(draws: DataFrame) -> DataFrame:
    """Arrays to nullable wide columns."""
    rest = [c for c in draws.columns if c not in ("lottery_type", "main_numbers", "bonus_numbers")]
    return draws.select(
        clean_type("lottery_type").alias("lottery_type"),
        *rest,
        *wide_main(F.col("main_numbers")),
        *wide_bonus(F.col("bonus_numbers")),
    )


def to_arrays(wide: DataFrame) -> DataFrame:
    """Wide columns to arrays; a missing main number fails the job, a missing bonus is skipped."""
    kind = F.col("lottery_type")
    main = main_from_wide(kind)
    complete = F.when(
        F.exists(main, lambda n: n.isNull()),
        F.raise_error(F.concat(F.lit("missing main number: draw_no="), F.col("draw_no"))),
    ).otherwise(main)
    return wide.select(
        *[c for c in wide.columns if c not in WIDE_NUMBERS],
        complete.alias("main_numbers"),
        bonus_from_wide(kind).alias("bonus_numbers"),
    )


def bonus_accessors(draws: DataFrame) -> DataFrame:
    """First and second bonus number, NULL where there is none."""
    return draws.withColumns(
        {
            "bonus1": F.get("bonus_numbers", F.lit(0)),
            "bonus2": F.get("bonus_numbers", F.lit(1)),
        }
    )


def target_sets(draws: DataFrame) -> DataFrame:
    """Distinct ascending main and bonus numbers of a target draw."""
    return draws.withColumns(
        {
            "target_main": F.array_sort(F.array_distinct("main_numbers")),
            "target_bonus": F.array_sort(F.array_distinct("bonus_numbers")),
        }
    )


def normalise_rows(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows with integer columns, all other rows with a ``reason``).

    A row needs a known pool, a positive draw_no and every main number; bonus
    columns may be NULL.
    """
    typed = pin(
        wide,
        lottery_type=clean_type("lottery_type"),
        draw_no=F.coalesce(F.col("draw_no").try_cast("bigint"), F.lit(0)),
        **{c: F.col(c).try_cast("int") for c in WIDE_NUMBERS},
    )
    needed = F.slice(
        F.array(*[F.col(c) for c in MAIN_COLUMNS]), F.lit(1), by_pool("lottery_type", "pick")
    )
    reason = (
        F.when(~is_known_type("lottery_type"), "unknown_pool")
        .when(F.col("draw_no") <= 0, "no_draw_no")
        .when(F.exists(needed, lambda n: n.isNull()), "missing_main_number")
    )
    judged = pin(typed, reason=reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")
