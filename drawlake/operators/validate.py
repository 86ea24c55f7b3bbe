"""Draw validation: every broken rule is named, bad rows are quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawlake.operators.pin import pin
from drawlake.spec import by_pool, clean_type, is_known_type

RULES = [
    "unsupported_type", "draw_no_not_positive", "main_count", "bonus_count",
    "out_of_range", "duplicate_main", "duplicate_number", "bad_date",
]


def parse_date(text: Column) -> Column:
    """``2026/4/2`` or ``2026-04-02`` as a date; NULL when it does not exist."""
    return F.call_function(
        "try_to_date", F.replace(text.cast("string"), F.lit("/"), F.lit("-")), F.lit("yyyy-M-d")
    )


def number_errors(
    main: Column, bonus: Column, lottery_type: Column, draw_no: Column, draw_date: Column
) -> Column:
    known = is_known_type(lottery_type)
    numbers = F.concat(main, bonus)
    out = (
        (F.size(F.array_intersect(numbers, F.array(F.lit(None).cast("int")))) > 0)
        | (F.array_min(numbers) < by_pool(lottery_type, "low"))
        | (F.array_max(numbers) > by_pool(lottery_type, "high"))
    )
    checks = {
        "unsupported_type": ~known,
        "draw_no_not_positive": draw_no.isNull() | (draw_no <= 0),
        "main_count": F.size(main) != by_pool(lottery_type, "pick"),
        "bonus_count": F.size(bonus) != by_pool(lottery_type, "bonus"),
        "out_of_range": out,
        "duplicate_main": F.size(F.array_distinct(main)) < F.size(main),
        "duplicate_number": F.size(F.array_distinct(numbers)) < F.size(numbers),
        "bad_date": parse_date(draw_date).isNull(),
    }
    broken = F.array(*[F.when(F.coalesce(checks[rule], F.lit(False)), rule) for rule in RULES])
    # Set functions, no lambdas: with those a projection of draws would not be compiled.
    return F.array_except(broken, F.array(F.lit(None).cast("string")))


def with_errors(draws: DataFrame) -> DataFrame:
    """Add ``errors``; lottery_type is normalised, NULL arrays count as empty."""
    empty = F.array().cast("array<int>")
    cleaned = (
        draws.withColumn("lottery_type", clean_type("lottery_type"))
        .withColumn("main_numbers", F.coalesce("main_numbers", empty))
        .withColumn("bonus_numbers", F.coalesce("bonus_numbers", empty))
    )
    errors = number_errors(
        F.col("main_numbers"), F.col("bonus_numbers"), F.col("lottery_type"),
        F.col("draw_no"), F.col("draw_date"),
    )
    return pin(cleaned, errors=errors)


def split_valid(draws: DataFrame, *, on_error: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(valid draws with a DATE, rejected draws with ``errors``).

    ``on_error="stop"`` makes the first invalid row fail the job instead.
    """
    if on_error not in ("quarantine", "stop"):
        raise ValueError("on_error must be quarantine or stop")
    checked = with_errors(draws)
    if on_error == "stop":
        message = F.concat(F.lit("invalid draw: "), F.array_join("errors", ","))
        checked = checked.withColumn(
            "errors", F.when(F.size("errors") > 0, F.raise_error(message)).otherwise(F.col("errors"))
        )
    good = checked.filter(F.size("errors") == 0).drop("errors")
    return good.withColumn("draw_date", parse_date(F.col("draw_date"))), checked.filter(
        F.size("errors") > 0
    )


def known_types(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of a known pool, rejected rows), case- and space-insensitive."""
    cleaned = rows.withColumn("lottery_type", clean_type("lottery_type"))
    known = is_known_type("lottery_type")
    return cleaned.filter(known), cleaned.filter(~known)


def require_fields(rows: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, rows with ``missing`` naming the absent or empty fields)."""
    missing = F.array_compact(
        F.array(
            *[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", f) for f in fields]
        )
    )
    checked = rows.withColumn("missing", missing)
    return checked.filter(F.size("missing") == 0).drop("missing"), checked.filter(
        F.size("missing") > 0
    )
