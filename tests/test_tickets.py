import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlake.functions import kernels as K
from drawlake.operators import tickets
from drawlake.operators.tickets import generate_tickets
from drawlake.operators.weights import Profile
from drawlake.spec import MAX_NUMBER, POOLS, check_pool


def runs(spark, scores, kind, seeds=(123,), bonus=None):
    main = [float(scores[n]) if n in scores else None for n in range(1, MAX_NUMBER + 1)]
    extra = None if bonus is None else [float(bonus.get(n, 0.0)) for n in range(1, MAX_NUMBER + 1)]
    rows = [(kind, s, main, extra) for s in seeds]
    return spark.createDataFrame(rows, "lottery_type string, seed bigint, main_scores array<double>, bonus_scores array<double>")


SIX = {n: 11.0 - n for n in range(1, 11)}
SEVEN = {n: 38.0 - n for n in range(1, 38)}


@pytest.mark.parametrize("kind,scores,strategy", [
    ("loto6", SIX, "default"), ("loto7", SEVEN, "default"), ("loto7", SEVEN, "mixed"),
    ("loto7", SEVEN, "second_prize_oriented"), ("loto6", SIX, "mixed"),
])
def test_tickets_are_unique_and_in_range(spark, kind, scores, strategy):
    pool = POOLS[kind]
    frame = runs(spark, scores, kind, seeds=range(50), bonus={n: n % 5 for n in range(1, 38)})
    for row in generate_tickets(frame, count=12, strategy=strategy).collect():
        assert row.error is None and len(row.tickets) == 12
        assert len({tuple(sorted(t)) for t in row.tickets}) == 12
        for t, mask in zip(row.tickets, row.ticket_masks):
            assert len(set(t)) == pool.pick and all(1 <= n <= pool.high for n in t)
            assert mask == sum(1 << n for n in t)


def test_same_seed_same_tickets_other_seed_other_tickets(spark):
    got = generate_tickets(runs(spark, SIX, "loto6", seeds=[5, 5, 6]), count=6, strategy="default").collect()
    assert got[0].tickets == got[1].tickets != got[2].tickets


def test_numbers_are_shown_by_weight_then_number(spark):
    """Three pairs of equal scores: pairs by score, and inside a pair the smaller number first."""
    scores = {40: 6, 17: 6, 33: 4, 8: 4, 21: 3, 12: 3}
    got = generate_tickets(runs(spark, scores, "loto6"), count=1, strategy="default").first()
    assert got.tickets == [[17, 40, 8, 33, 12, 21]]


def test_rank_tickets_use_the_documented_ranks():
    order = np.arange(43)[None, :]
    anchor, balanced, parity, spread, depth = tickets.rank_tickets(order, 6)
    assert anchor.tolist() == balanced.tolist() == [[0, 1, 2, 3, 4, 5]]
    assert sorted(parity[0] + 1) == [1, 2, 3, 4, 5, 6]
    assert spread[0].tolist() == [0, 2, 4, 6, 8, 10]
    assert (depth[0] + 1).tolist() == [1, 2, 3, 4, 15, 16]
    depth7 = tickets.rank_tickets(np.arange(37)[None, :], 7)[4]
    assert (depth7[0] + 1).tolist() == [1, 2, 3, 4, 17, 18, 19]


def test_parity_ticket_fills_up_from_the_top_pool():
    odd_first = np.array([[*range(0, 36, 2), *range(1, 37, 2)]])  # 18 odd numbers lead
    parity = tickets.rank_tickets(odd_first, 6)[2]
    assert (parity[0] + 1).tolist() == [1, 3, 5, 7, 9, 11]


def test_wrong_arguments_are_refused(spark):
    frame = runs(spark, SIX, "loto6")
    with pytest.raises(ValueError, match="must be positive"):
        generate_tickets(frame, count=0)
    with pytest.raises(ValueError, match="fewer combinations"):
        generate_tickets(frame, count=6_500_000)
    with pytest.raises(ValueError, match="no such"):
        generate_tickets(frame, count=1, strategy="lucky")
    with pytest.raises(ValueError, match="no such"):
        check_pool("mini")


def test_profile_strategy_is_for_the_seven_pool(spark):
    row = generate_tickets(runs(spark, SIX, "loto6"), count=3, strategy="second_prize_oriented").first()
    assert row.error == tickets.ONLY_SEVEN and row.tickets == []


def test_every_run_comes_out(spark):
    frame = runs(spark, SEVEN, "loto7")
    for kind in (" LOTO7 ", "mini", None):
        frame = frame.unionByName(runs(spark, SEVEN, "loto7").withColumn("lottery_type", F.lit(kind)))
    frame = frame.unionByName(runs(spark, SEVEN, "loto7").withColumn("main_scores", F.lit(None).cast("array<double>")))
    got = generate_tickets(frame, count=2, strategy="default").collect()
    assert len(got) == 5
    by_kind = {(r.lottery_type, bool(r.tickets)): r.error for r in got}
    assert by_kind == {
        ("loto7", True): None, (" LOTO7 ", True): None, ("mini", False): tickets.NO_POOL,
        (None, False): tickets.NO_POOL, ("loto7", False): tickets.NO_SCORES,
    }
    assert tickets.weighted_sample(frame.limit(4), ["lottery_type"]).count() == 4
    assert tickets.rank_ticket_rows(frame.limit(4), ["lottery_type"]).filter("ticket is null").count() == 2


def test_profiles_need_bonus_scores(spark):
    row = generate_tickets(runs(spark, SEVEN, "loto7"), count=2, strategy="second_prize_oriented").first()
    assert row.error == tickets.NO_BONUS


def test_excluded_tickets_are_not_made(spark):
    first = generate_tickets(runs(spark, SEVEN, "loto7"), count=4, strategy="default", drop=()).withColumnRenamed("ticket_masks", "taken")
    again = generate_tickets(first.drop("tickets", "error"), count=4, strategy="default", exclude_col="taken").first()
    assert len(again.tickets) == 4 and not set(again.ticket_masks) & set(first.first().taken)


def test_narrow_bonus_pool_opens_up(monkeypatch):
    """All open bonus numbers are mains: the pick comes from the rest of the pool, without repeats."""
    monkeypatch.setattr(tickets, "PROFILES", [Profile("narrow", 6, 3, 6, 1, (1.0, 0.0), (1.0, 0.0), 1.0)])
    main = np.tile(np.arange(37, 0, -1.0), (2, 1))
    book = tickets.profile_book(main, main, 3, np.arange(2))
    assert book.found.tolist() == [3, 3]
    assert all(len(set(t)) == 7 for run in book.numbers.tolist() for t in run)


def test_mixed_falls_back_without_bonus_scores(spark):
    plain = generate_tickets(runs(spark, SEVEN, "loto7"), count=5, strategy="default").first()
    mixed = generate_tickets(runs(spark, SEVEN, "loto7"), count=5, strategy="mixed").first()
    assert plain.tickets == mixed.tickets


def test_inclusion_frequencies_follow_successive_draws():
    """Two of three numbers with weights 1, 2, 3: exact inclusion probabilities are known."""
    size = 20_000
    noise = K.exponentials(np.arange(size), np.zeros(size, int), 0, "m", 3)
    columns = K.sample(noise, np.tile([1.0, 2.0, 3.0], (size, 1)), 2)
    seen = np.bincount(columns.ravel(), minlength=3) / size
    w = np.array([1.0, 2.0, 3.0])
    want = [w[i] / 6 + sum(w[j] / 6 * w[i] / (6 - w[j]) for j in range(3) if j != i) for i in range(3)]
    assert np.allclose(seen, want, atol=0.012)


def test_sample_larger_than_population_is_an_error():
    with pytest.raises(ValueError, match="than the pool has"):
        K.sample(np.ones((1, 3)), np.ones((1, 3)), 4)


def test_exhausted_profile_reports_an_error(monkeypatch):
    """With one possible number set the second ticket can never be unique."""
    monkeypatch.setattr(tickets, "PROFILES", [Profile("only", 6, 7, 6, 1, (1.0, 0.0), (1.0, 0.0), 1.0)])
    main = np.tile(np.arange(37, 0, -1.0), (3, 1))
    book = tickets.profile_book(main, main, 2, np.arange(3))
    assert book.found.tolist() == [1, 1, 1]
    assert all(set(t[0]) == set(range(1, 8)) for t in book.numbers.tolist())


def test_retries_find_the_remaining_sets(monkeypatch):
    """Eight candidate bonuses for one slot: eight tickets exist and all are found."""
    monkeypatch.setattr(tickets, "PROFILES", [Profile("few", 6, 14, 6, 1, (1.0, 0.0), (1.0, 0.0), 1.0)])
    main = np.tile(np.arange(37, 0, -1.0), (2, 1))
    book = tickets.profile_book(main, main, 8, np.arange(2))
    assert book.found.tolist() == [8, 8]
    assert all(len({tuple(sorted(t)) for t in run}) == 8 for run in book.numbers.tolist())


def test_row_weights_equal_batch_weights(spark):
    from drawlake.operators.weights import base_weights

    rows = [("s", "loto6", n, float(v)) for n, v in SIX.items()] + [("s", "loto6", 40, -1.0)]
    frame = spark.createDataFrame(rows, "series string, lottery_type string, number int, score double")
    got = base_weights(frame, ["series"]).orderBy("number").collect()
    scores = np.full((1, 43), np.nan)
    for n, v in SIX.items():
        scores[0, n - 1] = v
    want = K.weight_matrix(K.scaled(scores), 0.85)
    assert np.allclose([r.weight for r in got], want[0])
    assert [r.number for r in sorted(got, key=lambda r: r.weight_rank)] == (K.ranked(want)[0] + 1).tolist()


def test_ticket_labels(spark):
    from drawlake.operators.weights import profile_name

    rows = spark.createDataFrame([("loto7", 1), ("loto7", 5), ("loto7", 6), ("loto6", 2)], "k string, n int")
    names = [r[0] for r in rows.select(profile_name(F.col("k"), F.col("n"))).collect()]
    assert names == ["main_hot", "main5_bonus2_explore", "profile_6", "ticket_2"]


def test_last_score_of_a_number_counts(spark):
    from drawlake.operators.weights import pool_scores

    rows = [("s", "loto6", 3, 9.0, 1), ("s", "loto6", 3, 4.0, 2), ("s", "loto6", 5, 8.0, 1)]
    frame = spark.createDataFrame(rows, "series string, lottery_type string, number int, score double, seen int")
    last = {r.number: r.scaled for r in pool_scores(frame, ["series"], order_col="seen").collect()}
    assert (last[3], last[5]) == (0.5, 1.0)
    assert {r.number: r.scaled for r in pool_scores(frame, ["series"]).collect()}[3] == 1.0


def test_number_sets_equal_python_sets():
    from drawlake.functions.kernels import SET_BITS, NumberSets

    rng, sets, have = np.random.default_rng(3), NumberSets(), set()
    for _ in range(200):
        runs = rng.integers(0, 5, 9)
        keys = np.unique(NumberSets.keys(runs, rng.integers(0, 300, 9)))
        want = np.array([k in have for k in keys.tolist()])
        assert (sets.has(keys) == want).all()
        sets.add(keys[~want])
        have |= set(keys.tolist())
    sizes = [len(level) for level in sets.levels]
    assert sum(sizes) == len(have) and all(a > b for a, b in zip(sizes, sizes[1:]))
    top = NumberSets.keys(np.array([1 << 18]), np.array([(1 << SET_BITS) - 1]))
    assert top[0] > 0 and not sets.has(top)[0] and not NumberSets().has(top)[0]


def test_slices_do_not_change_tickets(spark, monkeypatch):
    from drawlake.operators import tickets

    scores = [[float((7 * n + k) % 11) for n in range(43)] for k in range(6)]
    kinds = ["loto6", "loto7", "loto7", "mini", None, "loto6"]
    rows = [(k, kind, 10 + k, s, s if k % 2 else None, [] if k else None) for k, (kind, s) in enumerate(zip(kinds, scores))]
    runs = spark.createDataFrame(
        rows, "k int, lottery_type string, seed bigint, main_scores array<double>, bonus_scores array<double>, ex array<bigint>"
    ).coalesce(1)
    made = lambda: sorted(map(str, tickets.generate_tickets(runs, count=30, exclude_col="ex").collect()))
    whole = made()
    monkeypatch.setattr(tickets, "SLICE_TICKETS", 60)
    assert made() == whole and len(whole) == 6


def test_ten_thousand_tickets_a_run_take_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from drawlake.operators import tickets

    runs = 250
    scores = [[float((7 * n + k) % 11) for n in range(43)] for k in range(runs)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["loto6"] * runs), pa.array(range(runs), pa.int64()), pa.array(scores)], names=["lottery_type", "seed", "main_scores"]
    )
    make = tickets._ticket_batches(["lottery_type"], 10_000, "default", None)
    tracemalloc.start()
    slices = 0
    for out in make(iter([batch])):
        assert out["tickets"].value_lengths().to_pylist() == [10_000] * out.num_rows
        assert all(len(set(m)) == 10_000 for m in out["ticket_masks"].to_pylist())
        slices += 1
        break
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert slices == 1 and out.num_rows == 104 and peak < 400 << 20


def test_seeds_of_a_window_give_the_tickets_of_its_exploded_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, kind, [float(v) for v in rng.random(43)], [float(v) for v in rng.random(43)]) for i, kind in enumerate(["loto6", "loto7", "mini"] * 4)]
    windows = spark.createDataFrame(rows, "draw_no bigint, lottery_type string, main_scores array<double>, bonus_scores array<double>")
    one_by_one = windows.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in (1, 2)])))
    for strategy in tickets.STRATEGIES:
        want = tickets.generate_tickets(one_by_one, count=6, strategy=strategy)
        got = tickets.generate_tickets(windows, count=6, strategy=strategy, seeds=[1, 2])
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
