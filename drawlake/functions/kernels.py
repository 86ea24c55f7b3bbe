"""Vectorised helpers for Arrow batches of runs.

Every matrix has one row per run (or training window) and one column per
number of the pool, number n in column n - 1. The helpers hold no state: Spark
partitions the runs, and a retried task repeats the same result because random
numbers are hashes of (seed, ticket, attempt, number).
"""

from __future__ import annotations

import numpy as np

from drawlake.spec import MAX_NUMBER

# Fixed values of the generators.
WEIGHT_FLOOR = 1e-6
USAGE_PENALTY = 0.35
TEMPERATURE_STEP = 0.1
TEMPERATURE_FLOOR = 0.55
MIN_TEMPERATURE = 0.1


def score_matrix(
    frequency: np.ndarray, recent: np.ndarray, idx: np.ndarray, weights: dict[str, np.ndarray]
) -> np.ndarray:
    """Scores of each window; NaN outside its observed range. ``idx`` < 0 means never seen.

    Same terms in the same order as the row form in ``operators.scores``.
    """
    seen = frequency > 0
    width = frequency.shape[1]
    low = seen.argmax(axis=1)
    high = width - 1 - seen[:, ::-1].argmax(axis=1)
    column = np.arange(width)
    inside = seen.any(axis=1)[:, None] & (column >= low[:, None]) & (column <= high[:, None])

    top_frequency = np.maximum(frequency.max(axis=1), 1)[:, None]
    top_recent = np.maximum(recent.max(axis=1), 1)[:, None]
    top_idx = np.maximum(idx.max(axis=1), 1)[:, None]
    age = idx / top_idx
    missing = idx < 0
    total = (
        frequency / top_frequency * weights["frequency"]
        + recent / top_recent * weights["recent"]
        + np.where(missing, 0.0, 1.0 - age) * weights["recency"]
        + np.where(missing, 1.0, np.minimum(age, 1.0)) * weights["absence"]
        - np.where(idx == 0, 1.0, 0.0) * weights["repeat_penalty"]
    )
    return np.where(inside, np.maximum(total, 0.0), np.nan)


def scaled(scores: np.ndarray) -> np.ndarray:
    """Scores over their row maximum; a row without positive scores becomes 0."""
    clean = np.maximum(np.nan_to_num(scores, nan=0.0), 0.0)
    top = clean.max(axis=1, keepdims=True)
    return np.divide(clean, top, out=np.zeros_like(clean), where=top > 0)


def weight_matrix(values: np.ndarray, temperature: float) -> np.ndarray:
    return 1.0 + np.power(np.maximum(values, 0.0), max(MIN_TEMPERATURE, temperature))


def rank_keys(weights: np.ndarray) -> np.ndarray:
    """Weights in units of 1e-12, negated: ascending order is weight descending."""
    return -np.floor(weights * 1e12 + 0.5).astype(np.int64)


# Bits of a column number below a rank key; keys of weights up to 2**17 leave room for them.
COLUMN_BITS = 6


def ranked(weights: np.ndarray) -> np.ndarray:
    """Columns by weight descending, then number.

    Key and column are sorted as one number: no ties, so no stable sort of indices is needed.
    """
    packed = rank_keys(weights) << COLUMN_BITS | np.arange(weights.shape[1])
    packed.sort(axis=1)
    return packed & ((1 << COLUMN_BITS) - 1)


def take(matrix: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return np.take_along_axis(matrix, columns, axis=1)


def number_masks(columns: np.ndarray) -> np.ndarray:
    """Number set of each row as a bit mask."""
    return np.left_shift(np.int64(1), columns + 1).sum(axis=1)


def in_weight_order(columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    ascending = np.sort(columns, axis=1)
    return take(ascending, ranked(take(weights, ascending)))


# Odd multipliers of seed, ticket, attempt, stage and number, and of the two mixing rounds.
COUNTER = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
STAGES = {"m": 0, "b": 1}


def uniforms(seeds: np.ndarray, tickets: np.ndarray, attempt: int, stage: str, width: int) -> np.ndarray:
    """A number in (0, 1) per run and pool number: a mixed 64-bit counter, the same wherever it is computed."""
    of_seed, of_ticket, of_attempt, of_stage, of_number = COUNTER
    fixed = (attempt * of_attempt + STAGES[stage] * of_stage) % (1 << 64)
    run = seeds.astype(np.int64).view(np.uint64) * np.uint64(of_seed) + tickets.astype(np.uint64) * np.uint64(of_ticket)
    number = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(of_number) + np.uint64(fixed)
    z = run[:, None] + number
    for shift, factor in MIX:
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z = (z ^ (z >> np.uint64(31))) >> np.uint64(12)
    return (z.astype(np.float64) + 0.5) / 2.0**52


def exponentials(seeds: np.ndarray, tickets: np.ndarray, attempt: int, stage: str, width: int) -> np.ndarray:
    """-ln(u) per run and number."""
    return -np.log(uniforms(seeds, tickets, attempt, stage, width))


def smallest(keys: np.ndarray, count: int) -> np.ndarray:
    """Columns of the ``count`` smallest keys of each row.

    With keys -ln(u) / weight this is a weighted sample without replacement,
    distributed like successive weighted draws (Efraimidis and Spirakis, 2006).
    """
    last = np.partition(keys, count - 1, axis=1)[:, count - 1 : count]
    chosen = keys <= last
    places = np.flatnonzero(chosen)
    if len(places) == len(keys) * count:
        return places.reshape(-1, count) % keys.shape[1]
    # Equal keys at the border.
    return np.argpartition(keys, count - 1, axis=1)[:, :count]


def sample(noise: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    if count > weights.shape[1]:
        raise ValueError("more numbers asked for than the pool has")
    return smallest(noise / np.maximum(weights, WEIGHT_FLOOR), count)


def ticket_weights(weights: np.ndarray, index: np.ndarray, usage: np.ndarray) -> np.ndarray:
    """Weights for the ticket at ``index``: flattened, and reduced by earlier use."""
    if (index <= 0).all():
        return weights
    power = np.maximum(TEMPERATURE_FLOOR, 1.0 - TEMPERATURE_STEP * index)[:, None]
    reduced = np.power(weights, power) / (1.0 + usage * USAGE_PENALTY)
    return np.where(index[:, None] <= 0, weights, reduced)


# Bits of a number set; the run stands above them in a key.
SET_BITS = MAX_NUMBER + 1


class NumberSets:
    """Number sets of the runs of a batch, for lookups by binary search.

    Sorted arrays of (run, set) keys whose sizes at least double from the last to the
    first: a new array merges with those that are not larger, like the carry of a counter.
    """

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    @staticmethod
    def keys(runs: np.ndarray, masks: np.ndarray) -> np.ndarray:
        return runs.astype(np.int64) << np.int64(SET_BITS) | masks

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            found |= level[at] == keys
        return found

    def add(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        keys = np.sort(keys)
        while self.levels and len(self.levels[-1]) <= len(keys):
            keys = np.sort(np.concatenate([self.levels.pop(), keys]), kind="stable")
        self.levels.append(keys)


class TicketBook:
    """Accepted tickets of a batch of runs; refuses a number set a run already has or must not get.

    ``taken`` lists, per run, the masks of number sets that are refused from the start.
    """

    def __init__(
        self, runs: int, count: int, pick: int, width: int, taken: list[list[int] | None] | None = None
    ) -> None:
        self.sets = NumberSets()
        for row, masks in enumerate(taken or ()):
            # Sets with other bits than the pool's can't be drawn.
            fits = np.array([m for m in masks or () if m is not None and 0 <= m < 1 << SET_BITS], np.int64)
            self.sets.add(NumberSets.keys(np.full(len(fits), row), fits))
        self.numbers = np.zeros((runs, count, pick), np.int32)
        self.masks = np.zeros((runs, count), np.int64)
        self.found = np.zeros(runs, np.int64)
        self.usage = np.zeros((runs, width), np.int64)
        self.count = count

    def open_runs(self) -> np.ndarray:
        return np.flatnonzero(self.found < self.count)

    def add(self, runs: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Offer one ticket per run, to be shown in order of ``weights``; True where accepted."""
        masks = number_masks(columns)
        keys = NumberSets.keys(runs, masks)
        new = ~self.sets.has(keys)
        self.sets.add(keys[new])
        rows, chosen = runs[new], columns[new]
        slot = self.found[rows]
        self.numbers[rows, slot] = in_weight_order(chosen, weights[new]) + 1
        self.masks[rows, slot] = masks[new]
        self.usage[rows[:, None], chosen] += 1
        self.found[rows] += 1
        return new
