"""Matching tickets against a draw: overlap, prize tier, near-miss points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawlake.functions.arrays import overlap
from drawlake.operators.weights import profile_name
from drawlake.spec import MAX_BONUS, MAX_PICK, TIER_LABELS

# Fixed values per pool: (main matches, bonus needed, tier or points), best first.
TIERS = {
    "loto6": [(6, 0, 1), (5, 1, 2), (5, 0, 3), (4, 0, 4), (3, 0, 5)],
    "loto7": [(7, 0, 1), (6, 1, 2), (6, 0, 3), (5, 0, 4), (4, 0, 5), (3, 1, 6)],
}
NEAR_MISS = {
    "loto6": [(6, 0, 5000), (5, 1, 3000), (5, 0, 1500), (4, 0, 500), (3, 0, 100)],
    "loto7": [
        (7, 0, 5000), (6, 1, 3000), (6, 0, 1500), (5, 1, 800), (5, 0, 500),
        (4, 1, 200), (4, 0, 100), (3, 1, 50),
    ],
}


_BONUS_WIDTH = MAX_BONUS + 1


def _table(rules: dict, pool: str) -> Column:
    """Rules of a pool as a constant array indexed by main * width + bonus."""
    values = [
        next((v for need, extra, v in rules[pool] if main == need and bonus >= extra), 0)
        for main in range(MAX_PICK + 1)
        for bonus in range(_BONUS_WIDTH)
    ]
    return F.array(*[F.lit(v) for v in values])


def _lookup(rules: dict, lottery_type: Column, main: Column, bonus: Column) -> Column:
    first, second = TIERS
    table = F.when(lottery_type == first, _table(rules, first)).when(
        lottery_type == second, _table(rules, second)
    )
    return F.get(table, main * _BONUS_WIDTH + F.least(bonus, F.lit(MAX_BONUS)))


def prize_tier(lottery_type: Column, main: Column, bonus: Column) -> Column:
    return _lookup(TIERS, lottery_type, main, bonus)


def near_miss(lottery_type: Column, main: Column, bonus: Column) -> Column:
    return _lookup(NEAR_MISS, lottery_type, main, bonus)


def outcome_key(points: Column, main: Column, bonus: Column, tier: Column) -> Column:
    """(points, main, bonus, tier) as one BIGINT in the same order.

    A maximum over a number stays in hash aggregation; over a struct it would
    fall back to sorting.
    """
    return ((points * 10 + main) * 10 + bonus) * 10 + tier


def outcome_parts(key: Column) -> dict[str, Column]:
    """The fields of an outcome key."""
    digit = lambda place: F.floor(key / place).cast("int") % 10
    return {
        "near_miss_score": F.floor(key / 1000).cast("int"),
        "main_match": digit(100),
        "bonus_match": digit(10),
        "prize_tier": digit(1),
    }


def tier_label(tier: Column) -> Column:
    case = F.when(tier == 1, TIER_LABELS[1])
    for value, label in TIER_LABELS.items():
        case = case.when(tier == value, label)
    return case


def judge(tickets: DataFrame, ticket_mask: str = "ticket_mask") -> DataFrame:
    """Add match counts, tier and points to ticket rows that carry the target's masks.

    Sets are bit masks, so an overlap is one AND and one bit count.
    """
    kind = F.col("lottery_type")
    main, bonus = F.col("main_match"), F.col("bonus_match")
    return (
        tickets.withColumn("main_match", overlap(F.col(ticket_mask), F.col("main_mask")))
        .withColumn("bonus_match", overlap(F.col(ticket_mask), F.col("bonus_mask")))
        .withColumn("prize_tier", prize_tier(kind, main, bonus))
        .withColumn("near_miss_score", near_miss(kind, main, bonus))
    )


def judged_tickets(runs: DataFrame) -> DataFrame:
    """One judged row per ticket of each run; runs without tickets give no rows."""
    rows = runs.select(
        *[c for c in runs.columns if c not in ("tickets", "ticket_masks")],
        F.posexplode(F.arrays_zip("tickets", "ticket_masks")).alias("_pos", "_ticket"),
    )
    rows = rows.withColumns(
        {
            "ticket_no": F.col("_pos") + 1,
            "prediction": F.col("_ticket.tickets"),
            "ticket_mask": F.col("_ticket.ticket_masks"),
        }
    ).drop("_pos", "_ticket")
    return judge(rows).withColumn("profile_name", profile_name(F.col("lottery_type"), F.col("ticket_no")))


def ticket_structs() -> Column:
    """The judged tickets of a run as one array of structs, without a shuffle."""
    kind = F.col("lottery_type")

    def judged(pair: Column, i: Column) -> Column:
        main = overlap(pair["ticket_masks"], F.col("main_mask"))
        bonus = overlap(pair["ticket_masks"], F.col("bonus_mask"))
        return F.struct(
            (i + 1).alias("ticket_no"),
            pair["tickets"].alias("prediction"),
            main.alias("main_match"),
            bonus.alias("bonus_match"),
            prize_tier(kind, main, bonus).alias("prize_tier"),
            near_miss(kind, main, bonus).alias("near_miss_score"),
        )

    return F.transform(F.arrays_zip("tickets", "ticket_masks"), judged)


def ticket_keys() -> Column:
    """The outcome keys of a run's tickets as an array, without a shuffle."""
    kind = F.col("lottery_type")

    def key(mask: Column) -> Column:
        main = overlap(mask, F.col("main_mask"))
        bonus = overlap(mask, F.col("bonus_mask"))
        return outcome_key(near_miss(kind, main, bonus), main, bonus, prize_tier(kind, main, bonus))

    return F.transform("ticket_masks", key)
