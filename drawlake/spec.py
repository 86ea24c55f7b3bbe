"""Pool definitions and other fixed values shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class PoolSpec:
    low: int
    high: int
    pick: int
    bonus: int

    @property
    def combinations(self) -> int:
        return comb(self.high - self.low + 1, self.pick)


# The two pools (6 of 43 + 1 bonus, 7 of 37 + 2 bonuses).
POOLS = {
    "loto6": PoolSpec(low=1, high=43, pick=6, bonus=1),
    "loto7": PoolSpec(low=1, high=37, pick=7, bonus=2),
}

MAX_NUMBER = max(p.high for p in POOLS.values())
MAX_PICK = max(p.pick for p in POOLS.values())
MAX_BONUS = max(p.bonus for p in POOLS.values())

# A draw is also carried as a bit mask in one BIGINT (bit n = number n present).
assert MAX_NUMBER <= 62

MAIN_COLUMNS = [f"n{i}" for i in range(1, MAX_PICK + 1)]
BONUS_COLUMNS = [f"b{i}" for i in range(1, MAX_BONUS + 1)]

# Column order of the canonical CSV and its NULL marker.
CSV_COLUMNS = ["lottery_type", "draw_no", "draw_date", *MAIN_COLUMNS, *BONUS_COLUMNS, "source_url"]
NULL_MARKER = "\\N"

# Tier labels; tier 0 means no prize.
TIER_LABELS = {
    1: "1等相当",
    2: "2等相当",
    3: "3等相当",
    4: "4等相当",
    5: "5等相当",
    6: "6等相当",
    0: "該当なし",
}


def clean_type(column: str | Column) -> Column:
    """Case- and space-insensitive pool name."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.trim(column))


def is_known_type(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.isin(*POOLS), F.lit(False))


def by_pool(column: str | Column, attribute: str) -> Column:
    """Pool attribute as a CASE over the pool name.

    The dimension has one row per pool, so it is folded into the expression
    and costs neither a join nor a broadcast. NULL for an unknown pool.
    """
    column = F.col(column) if isinstance(column, str) else column
    names = list(POOLS)
    case = F.when(column == names[0], F.lit(getattr(POOLS[names[0]], attribute)))
    for name in names[1:]:
        case = case.when(column == name, F.lit(getattr(POOLS[name], attribute)))
    return case


def check_pool(name: str) -> str:
    cleaned = str(name).strip().lower()
    if cleaned not in POOLS:
        raise ValueError(f"no such pool: {name}")
    return cleaned


def check_ticket_count(count: int) -> int:
    """Ticket count must be positive and within every pool's number of combinations."""
    if count <= 0:
        raise ValueError("the number of tickets must be positive")
    if count > min(p.combinations for p in POOLS.values()):
        raise ValueError("a pool has fewer combinations than tickets asked for")
    return count


def check_limits(limits: list[int]) -> list[int]:
    """Distinct, sorted, positive history limits."""
    if not limits or any(limit <= 0 for limit in limits):
        raise ValueError("limits and counts must be positive")
    return sorted(set(limits))


def check_range(low: int, high: int, name: str) -> list[int]:
    """Inclusive parameter range, e.g. seeds from..to."""
    if high < low:
        raise ValueError(f"{name}: upper end must not be below the lower end")
    return list(range(low, high + 1))
