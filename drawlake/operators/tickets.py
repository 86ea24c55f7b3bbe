"""Ticket generation: one row per run in, the run's tickets out.

Ticket t depends on the tickets before it (uniqueness, usage), but runs are
independent. So the loop over tickets runs once per Arrow batch for all runs
in it, as matrix operations; there is no shuffle and no per-row Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from drawlake.functions import kernels as K
from drawlake.operators.weights import DEFAULT_TEMPERATURE, DISPLAY_BLEND, PROFILES
from drawlake.spec import MAX_NUMBER, POOLS, PoolSpec, check_ticket_count

# Fixed values of the generators.
ATTEMPTS_PER_TICKET = 300
PROFILE_ATTEMPTS = 500
ATTEMPTS_PER_STEP = 100
MIXED_SEED_SHIFT = 10_000

STRATEGIES = ("default", "second_prize_oriented", "mixed")
RANK_TICKETS = ["anchor", "balanced", "even_odd", "spread", "mixed_depth"]
TOO_FEW = "too few different tickets were found for this run"
ONLY_SEVEN = "profile tickets exist for the 7-pick pool only"
NO_BONUS = "profile tickets need bonus scores, this run has none"
NO_POOL = "the run names no known pool"
NO_SCORES = "the run has no scores"

TICKETS = T.ArrayType(T.ArrayType(T.IntegerType()))
SCORES = T.ArrayType(T.DoubleType())


def rank_tickets(order: np.ndarray, pick: int) -> list[np.ndarray]:
    """The five tickets that depend on the ranking only, in ``RANK_TICKETS`` order.

    Positions in the ranking: anchor 1..k; balanced the same for both pools;
    spread every second; mixed depth a head, as many after it, and a tail from
    2k further down. Even/odd takes halves of each parity from the best 3k.
    """
    head = max(2, pick // 3)
    tail = head + 2 * pick
    depth = [*range(2 * head), *range(tail, tail + pick - 2 * head)]
    top = order[:, : 3 * pick]
    odd_number = top % 2 == 0
    rank = np.arange(top.shape[1])
    place = np.where(odd_number, np.cumsum(odd_number, axis=1), np.cumsum(~odd_number, axis=1))
    quota = np.where(odd_number, pick - pick // 2, pick // 2)
    wanted = place <= quota
    # Wanted numbers first, the rest of the top pool fills up by rank.
    parity = K.take(top, np.argsort(np.where(wanted, rank, rank + top.shape[1]), axis=1)[:, :pick])
    anchor = order[:, :pick]
    return [anchor, anchor, parity, order[:, 0 : 2 * pick : 2], order[:, depth]]


def default_book(
    scores: np.ndarray, pool: PoolSpec, count: int, seeds: np.ndarray, taken: list | None = None, of: np.ndarray | None = None
) -> K.TicketBook:
    """Rank tickets first, then weighted samples with flattened, usage-reduced weights.

    ``of`` is each run's row of ``scores``: seeds of a window share what depends on its scores.
    """
    of = np.arange(len(scores)) if of is None else of
    shared = K.weight_matrix(K.scaled(scores), DEFAULT_TEMPERATURE)
    weights = shared[of]
    book = K.TicketBook(len(of), count, pool.pick, pool.high, taken)
    for columns in rank_tickets(K.ranked(shared), pool.pick):
        runs = book.open_runs()
        book.add(runs, columns[of[runs]], weights[runs])
    for attempt in range(max(ATTEMPTS_PER_TICKET, ATTEMPTS_PER_TICKET * count)):
        runs = book.open_runs()
        if not len(runs):
            break
        index = book.found[runs]
        adjusted = K.ticket_weights(weights[runs], index, book.usage[runs])
        noise = K.exponentials(seeds[runs], index, attempt, "m", pool.high)
        book.add(runs, K.sample(noise, adjusted, pool.pick), adjusted)
    return book


def profile_book(
    main: np.ndarray, bonus: np.ndarray, count: int, seeds: np.ndarray, taken: list | None = None, of: np.ndarray | None = None
) -> K.TicketBook:
    """One ticket per profile: mains from the best main pool, then bonus picks from the rest.

    A duplicate is retried with a penalty on its numbers; a run that cannot
    complete a ticket stops there.
    """
    pool = POOLS["loto7"]
    of = np.arange(len(main)) if of is None else of
    m, b = K.scaled(main), K.scaled(bonus)
    display = K.weight_matrix(m * DISPLAY_BLEND[0] + b * DISPLAY_BLEND[1], 1.0)
    book = K.TicketBook(len(of), count, pool.pick, pool.high, taken)
    for ticket in range(count):
        profile = PROFILES[ticket % len(PROFILES)]
        (ma, mb), (ba, bb) = profile.main_blend, profile.bonus_blend
        main_weights = K.weight_matrix(m * ma + b * mb, profile.temperature)
        bonus_weights = K.weight_matrix(m * ba + b * bb, profile.temperature)
        closed = _outside_pool(main_weights, profile.main_pool)
        bonus_closed = _outside_pool(bonus_weights, profile.bonus_pool)
        # Until a ticket is refused its weights are those of all seeds.
        fresh = {
            stage: _sampled(K.ticket_weights(weights, np.full(len(main), ticket), np.zeros((), np.int64)))
            for stage, weights in (("m", main_weights), ("b", bonus_weights))
        }
        penalty = np.zeros((len(of), pool.high), np.int64)
        runs = np.flatnonzero(book.found == ticket)
        for attempt in range(PROFILE_ATTEMPTS):
            if not len(runs):
                break
            window = of[runs]
            index = np.full(len(runs), ticket + attempt // ATTEMPTS_PER_STEP)
            slot = np.full(len(runs), ticket)
            line = np.arange(len(runs))[:, None]

            def keys(weights: np.ndarray, stage: str) -> np.ndarray:
                noise = K.exponentials(seeds[runs], slot, attempt, stage, pool.high)
                if attempt == 0:
                    return noise / fresh[stage][window]
                return noise / _sampled(K.ticket_weights(weights[window], index, penalty[runs]))

            main_keys = keys(main_weights, "m")
            main_keys[closed[window]] = np.inf
            mains = K.smallest(main_keys, profile.main_count)
            bonus_keys = keys(bonus_weights, "b")
            bonus_keys[line, mains] = np.inf
            if bonus_closed.any():
                whole_keys = bonus_keys
                bonus_keys = np.where(bonus_closed[window], np.inf, whole_keys)
                # Too few open bonus numbers beside the mains: the whole pool is open.
                narrow = np.isfinite(bonus_keys).sum(axis=1) < profile.bonus_count
                bonus_keys[narrow] = whole_keys[narrow]
            extra = K.smallest(bonus_keys, profile.bonus_count)
            columns = np.hstack([mains, extra])
            refused = ~book.add(runs, columns, display[window])
            penalty[runs[refused][:, None], columns[refused]] += 1
            runs = runs[refused]
    return book


def _sampled(weights: np.ndarray) -> np.ndarray:
    return np.maximum(weights, K.WEIGHT_FLOOR)


def _outside_pool(weights: np.ndarray, size: int) -> np.ndarray:
    closed = np.zeros(weights.shape, bool)
    if size < weights.shape[1]:
        closed[np.arange(len(weights))[:, None], K.ranked(weights)[:, size:]] = True
    return closed


def generate_tickets(
    runs: DataFrame,
    *,
    count: int,
    strategy: str = "mixed",
    exclude_col: str | None = None,
    drop: tuple[str, ...] = ("main_scores", "bonus_scores"),
    seeds: list[int] | None = None,
) -> DataFrame:
    """Add ``tickets``, ``ticket_masks`` and ``error`` to runs with lottery_type, seed and scores.

    With ``seeds`` the rows are windows without a seed, and each becomes a run per seed.

    default: the default generator for both pools. second_prize_oriented: the
    profile generator, an error for the 6-pick pool and for runs without bonus
    scores. mixed: profiles with a shifted seed where pool and bonus scores allow it,
    otherwise default. ``exclude_col`` holds masks of tickets a run must not get. A
    run with fewer than ``count`` unique tickets, an unknown pool or no scores gets
    an error text; every run comes out.
    """
    strategy = str(strategy).strip().lower()
    if strategy not in STRATEGIES:
        raise ValueError(f"no such ticket strategy: {strategy}")
    check_ticket_count(count)
    drop = (*drop, *([exclude_col] if exclude_col else []))
    kept = [f for f in runs.schema.fields if f.name not in drop]
    schema = T.StructType(
        [
            *kept,
            *([T.StructField("seed", T.LongType())] if seeds else []),
            T.StructField("tickets", TICKETS),
            T.StructField("ticket_masks", T.ArrayType(T.LongType())),
            T.StructField("error", T.StringType()),
        ]
    )
    return runs.mapInArrow(_ticket_batches([f.name for f in kept], count, strategy, exclude_col, seeds), schema)


def pool_names(column: pa.Array) -> np.ndarray:
    """Cleaned pool names; the empty text for NULL."""
    coded = column.dictionary_encode()
    # The last name is that of NULL.
    names = np.array([*(str(v or "").strip().lower() for v in coded.dictionary.to_pylist()), ""], dtype=object)
    return names[coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)]


# Tickets that the books of one slice of runs hold, some forty bytes each, and its runs:
# their matrices stay in the cache of a core.
SLICE_TICKETS = 1 << 20
SLICE_RUNS = 1 << 10


def _slices(rows: np.ndarray, count: int) -> list[np.ndarray]:
    """Rows in parts whose tickets are bounded together; a run is one part at least."""
    most = max(1, min(SLICE_RUNS, SLICE_TICKETS // count))
    return [rows[at : at + most] for at in range(0, len(rows), most)]


def _ticket_batches(
    kept: list[str], count: int, strategy: str, exclude_col: str | None, seeds: list[int] | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shift = MIXED_SEED_SHIFT if strategy == "mixed" else 0
    names = [*kept, *(["seed"] if seeds else []), "tickets", "ticket_masks", "error"]
    each = len(seeds or [0])

    def valid(batch: pa.RecordBatch, column: str) -> np.ndarray:
        if column not in batch.schema.names:
            return np.zeros(batch.num_rows, bool)
        return batch[column].is_valid().to_numpy(zero_copy_only=False)

    def finished(part: pa.RecordBatch, of: np.ndarray, of_seed: np.ndarray, book: K.TicketBook, message: str) -> pa.RecordBatch:
        columns = [part[c].take(pa.array(of)) if seeds else part[c] for c in kept]
        return pa.RecordBatch.from_arrays(
            [*columns, *([pa.array(of_seed)] if seeds else []), *_book_columns(book, message)], names=names
        )

    def runs_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Row and seed of every run."""
        of = np.repeat(np.arange(part.num_rows), each)
        return of, np.tile(np.array(seeds, np.int64), part.num_rows) if seeds else part["seed"].to_numpy(zero_copy_only=False)

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, has_bonus, has_main = pool_names(batch["lottery_type"]), valid(batch, "bonus_scores"), valid(batch, "main_scores")
            known = np.isin(types, list(POOLS))
            refused = [(~known, NO_POOL), (known & ~has_main, NO_SCORES)]
            if strategy == "second_prize_oriented":
                refused += [
                    (known & has_main & (types != "loto7"), ONLY_SEVEN),
                    (known & has_main & (types == "loto7") & ~has_bonus, NO_BONUS),
                ]
            for chosen, message in refused:
                for rows in _slices(np.flatnonzero(chosen), count * each):
                    part = batch.take(pa.array(rows))
                    of, of_seed = runs_of(part)
                    yield finished(part, of, of_seed, K.TicketBook(len(of), count, 1, 1), message)
            for name, pool in POOLS.items():
                of_pool = (types == name) & has_main
                profiled = of_pool & has_bonus & (name == "loto7") & (strategy != "default")
                plain = of_pool & ~profiled & (strategy != "second_prize_oriented")
                kinds = ((profiled, True), (plain, False))
                for rows, by_profile in ((r, b) for chosen, b in kinds for r in _slices(np.flatnonzero(chosen), count * each)):
                    part = batch.take(pa.array(rows))
                    of, of_seed = runs_of(part)
                    taken = part[exclude_col].take(pa.array(of)).to_pylist() if exclude_col else None
                    main = list_matrix(part["main_scores"])[:, : pool.high]
                    if by_profile:
                        bonus = list_matrix(part["bonus_scores"])[:, : pool.high]
                        book = profile_book(main, bonus, count, of_seed + shift, taken, of)
                    else:
                        book = default_book(main, pool, count, of_seed, taken, of)
                    yield finished(part, of, of_seed, book, TOO_FEW)

    return generate


def _book_columns(book: K.TicketBook, message: str) -> list[pa.Array]:
    """tickets, ticket_masks and error of a batch, built without per-row objects."""
    used = np.arange(book.count) < book.found[:, None]
    ends = np.concatenate([[0], np.cumsum(book.found)]).astype(np.int32)
    numbers = book.numbers[used]
    starts = np.arange(0, numbers.size + 1, numbers.shape[1], dtype=np.int32)
    tickets = pa.ListArray.from_arrays(starts, pa.array(numbers.ravel()))
    failed = book.found < book.count
    return [
        pa.ListArray.from_arrays(ends, tickets),
        pa.ListArray.from_arrays(ends, pa.array(book.masks[used])),
        pa.array(np.full(len(failed), message, object), pa.string(), mask=~failed),
    ]


def list_matrix(column: pa.Array) -> np.ndarray:
    """List column with one value per number as a matrix; NULL values and rows become NaN."""
    matrix = np.full((len(column), MAX_NUMBER), np.nan)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    matrix[valid] = values.reshape(-1, MAX_NUMBER)
    return matrix


def rank_ticket_rows(runs: DataFrame, run_cols: list[str]) -> DataFrame:
    """Rank tickets of each run as rows: run, strategy_no, strategy, ticket; repeats of a
    number set inside a run are dropped, the first strategy keeps it. A run of an unknown
    pool gives one row with neither number nor ticket."""
    schema = T.StructType(
        [runs.schema[c] for c in run_cols]
        + [
            T.StructField("strategy_no", T.IntegerType()),
            T.StructField("strategy", T.StringType()),
            T.StructField("ticket", T.ArrayType(T.IntegerType())),
        ]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = pool_names(batch["lottery_type"])
            main = list_matrix(batch["main_scores"])
            other = np.flatnonzero(~np.isin(types, list(POOLS)))
            if len(other):
                picked = batch.select(run_cols).take(pa.array(other))
                blank = [pa.nulls(len(other), t) for t in (pa.int32(), pa.string(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns, *blank], names=[*run_cols, "strategy_no", "strategy", "ticket"]
                )
            for name, pool in POOLS.items():
                rows = np.flatnonzero(types == name)
                if not len(rows):
                    continue
                weights = K.weight_matrix(K.scaled(main[rows, : pool.high]), DEFAULT_TEMPERATURE)
                earlier = np.zeros((len(rows), 0), np.int64)
                for no, columns in enumerate(rank_tickets(K.ranked(weights), pool.pick), start=1):
                    sets = K.number_masks(columns)[:, None]
                    new = np.flatnonzero(~(earlier == sets).any(axis=1))
                    earlier = np.hstack([earlier, sets])
                    shown = K.in_weight_order(columns[new], weights[new]) + 1
                    picked = batch.select(run_cols).take(pa.array(rows[new]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *picked.columns,
                            pa.array(np.full(len(new), no, np.int32)),
                            pa.array([RANK_TICKETS[no - 1]] * len(new), pa.string()),
                            pa.array(shown.tolist(), pa.list_(pa.int32())),
                        ],
                        names=[*run_cols, "strategy_no", "strategy", "ticket"],
                    )

    return runs.mapInArrow(build, schema)


def weighted_sample(runs: DataFrame, run_cols: list[str], *, seed_col: str = "seed") -> DataFrame:
    """One weighted sample of ``pick`` numbers per run from its base weights, ascending; NULL for an unknown pool."""
    schema = T.StructType(
        [runs.schema[c] for c in run_cols]
        + [T.StructField("sample", T.ArrayType(T.IntegerType()))]
    )

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = pool_names(batch["lottery_type"])
            seeds = batch[seed_col].to_numpy()
            main = list_matrix(batch["main_scores"])
            other = np.flatnonzero(~np.isin(types, list(POOLS)))
            if len(other):
                picked = batch.select(run_cols).take(pa.array(other))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns, pa.nulls(len(other), pa.list_(pa.int32()))], names=[*run_cols, "sample"]
                )
            for name, pool in POOLS.items():
                rows = np.flatnonzero(types == name)
                if not len(rows):
                    continue
                weights = K.weight_matrix(K.scaled(main[rows, : pool.high]), DEFAULT_TEMPERATURE)
                noise = K.exponentials(seeds[rows], np.zeros(len(rows), int), 0, "m", pool.high)
                columns = np.sort(K.sample(noise, weights, pool.pick), axis=1) + 1
                picked = batch.select(run_cols).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns, pa.array(columns.tolist(), pa.list_(pa.int32()))],
                    names=[*run_cols, "sample"],
                )

    return runs.mapInArrow(draw, schema)
