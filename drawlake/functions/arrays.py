"""Array and bit-mask expressions for number sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from drawlake.spec import BONUS_COLUMNS, MAIN_COLUMNS, MAX_NUMBER, by_pool


def distinct_numbers(values: Column) -> Column:
    """Positive integers of a draw in first-seen order; unusable input becomes empty.

    ``values`` may hold text: entries that are not integers are dropped.
    """
    parsed = F.transform(values, lambda v: F.trim(v.cast("string")).try_cast("int"))
    return F.coalesce(
        F.array_distinct(F.filter(parsed, lambda n: n > 0)),
        F.array().cast("array<int>"),
    )


def to_mask(numbers: Column) -> Column:
    """Number set as a BIGINT with bit n set for number n (1..62)."""
    return F.aggregate(
        numbers,
        F.lit(0).cast("bigint"),
        lambda mask, n: mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), n)),
    )


def has_number(mask: Column, number: int | Column) -> Column:
    number = F.lit(number) if isinstance(number, int) else number
    return F.call_function("getbit", mask, number).cast("int")


def from_mask(mask: Column) -> Column:
    """Ascending numbers of a mask."""
    return F.filter(
        F.sequence(F.lit(1), F.lit(MAX_NUMBER)), lambda n: has_number(mask, n) == 1
    )


def overlap(left: Column, right: Column) -> Column:
    """Size of the intersection of two masks."""
    return F.bit_count(left.bitwiseAND(right))


def wide_main(numbers: Column) -> list[Column]:
    return [F.get(numbers, F.lit(i)).alias(c) for i, c in enumerate(MAIN_COLUMNS)]


def wide_bonus(numbers: Column) -> list[Column]:
    return [F.get(numbers, F.lit(i)).alias(c) for i, c in enumerate(BONUS_COLUMNS)]


def main_from_wide(lottery_type: Column) -> Column:
    """First ``pick`` wide columns as an array (NULL entries kept for validation)."""
    return F.slice(
        F.array(*[F.col(c).cast("int") for c in MAIN_COLUMNS]), 1, by_pool(lottery_type, "pick")
    )


def bonus_from_wide(lottery_type: Column) -> Column:
    """First ``bonus`` wide columns as an array without NULLs."""
    return F.array_compact(
        F.slice(
            F.array(*[F.col(c).cast("int") for c in BONUS_COLUMNS]),
            1,
            by_pool(lottery_type, "bonus"),
        )
    )


def first_numbers(text: Column, count: Column) -> Column:
    """First ``count`` integers found in a text, NULL when there are fewer."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return F.when(
        F.size(found) >= count,
        F.transform(F.slice(found, 1, count), lambda v: v.try_cast("int")),
    )
