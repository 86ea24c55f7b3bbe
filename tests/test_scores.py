import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import MAIN, scores as brute_scores
from drawlake.operators import scores
from drawlake.operators.rank import rank_draws
from drawlake.operators.sliding import window_features


def history(spark, newest_first, series="s", kind="loto6"):
    rows = [(series, kind, len(newest_first) - i, [str(v) if v is not None else None for v in d] if isinstance(d, list) else None)
            for i, d in enumerate(newest_first)]
    return spark.createDataFrame(rows, "series string, lottery_type string, draw_no bigint, main_numbers array<string>")


def scored(spark, newest_first):
    ranked = rank_draws(history(spark, newest_first), ["series"], unique=True)
    return {r.number: r.score for r in scores.number_scores(ranked, ["series"]).collect()}


def test_frequent_and_newer_numbers_score_higher(spark):
    draws = [[1, 2, 3, 4, 5, 6], [1, 3, 5, 7, 9, 11], [2, 3, 5, 8, 13, 21]]
    got = scored(spark, draws)
    assert got[3] > got[21] and got[5] > got[21] and got[7] > got[21]
    want = brute_scores(draws)
    assert got.keys() == want.keys()
    assert all(abs(got[n] - want[n]) < 1e-12 for n in want)


def test_empty_history_has_no_scores(spark):
    assert scored(spark, [[]]) == {}


def test_unusable_values_are_dropped_but_the_draw_counts(spark):
    got = scored(spark, [[1, 2, "3", None, -4, 2], [2, "x", 5], None])
    want = brute_scores([[1, 2, 3], [2, 5], []])
    assert got.keys() == want.keys() and -4 not in got
    assert got[2] > got[1]
    assert all(abs(got[n] - want[n]) < 1e-12 for n in want)


def test_combined_scores_fill_missing_sides(spark):
    main = spark.createDataFrame([("s", 1, 2.0), ("s", 2, 1.0)], "series string, number int, score double")
    bonus = spark.createDataFrame([("s", 2, 4.0), ("s", 9, 1.0)], "series string, number int, score double")
    got = {r.number: r.score for r in scores.combined_scores(main, bonus, ["series"]).collect()}
    assert got == pytest.approx({1: 1.6, 2: 1.6, 9: 0.2})
    with pytest.raises(ValueError, match="below zero"):
        scores.combined_scores(main, bonus, ["series"], main_weight=-1.0)


def synthetic(spark, size, series="s", kind="loto6"):
    """Draws with irregular gaps and a few empty ones."""
    number = lambda i, k: (i * (k + 3) * 7 + i * i * (k + 1)) % 43 + 1
    rows = []
    for i in range(size):
        main = [] if i % 97 == 5 else sorted({number(i, k) for k in range(6)})
        bonus = [] if i % 3 == 0 else [number(i, 11)]
        rows.append((series, kind, 3 * i + 1, main, bonus))
    return spark.createDataFrame(
        rows, "series string, lottery_type string, draw_no bigint, main_numbers array<int>, bonus_numbers array<int>"
    ), rows


def test_sliding_scores_equal_recomputing_every_window(spark):
    d, rows = synthetic(spark, 2300)
    ranked = rank_draws(d, ["series"], unique=True)
    limits = [1, 2, 3, 4, 7, 11, 50, 200]
    got = window_features(ranked, ["series"], limits, keep=["draw_no"], weights=scores.ScoreWeights()).collect()
    assert len(got) == len(limits) * (len(rows) - 1)
    bonus_w = scores.bonus_weights(scores.ScoreWeights()).__dict__
    # Every target near the start and around the chunk borders, a stride elsewhere.
    checked = 0
    for r in got:
        if not (r.rk < 230 or abs(r.rk - 1024) < 6 or abs(r.rk - 1600) < 6 or abs(r.rk - 2048) < 6 or r.rk % 101 == 0):
            continue
        newest = rows[max(0, r.rk - 1 - r.history_limit) : r.rk - 1][::-1]
        assert r.history_count == len(newest)
        for values, column, w in ((r.main_scores, 3, MAIN), (r.bonus_scores, 4, bonus_w)):
            want = brute_scores([x[column] for x in newest], w) if any(x[column] for x in newest) else {}
            have = {n: v for n, v in enumerate(values, start=1) if v is not None}
            assert have.keys() == want.keys(), (r.rk, r.history_limit)
            assert all(abs(have[n] - want[n]) < 1e-9 for n in want), (r.rk, r.history_limit)
        checked += 1
    assert checked > 1500


def test_marked_targets_only(spark):
    d, _ = synthetic(spark, 2300)
    ranked = rank_draws(d, ["series"], unique=True)
    everything = window_features(ranked, ["series"], [20], keep=["draw_no"], weights=scores.ScoreWeights())
    marked = ranked.withColumn("wanted", F.col("rk").isin(1, 2, 1030, 2300))
    some = window_features(marked, ["series"], [20], keep=["draw_no"], weights=scores.ScoreWeights(), target_col="wanted")
    got = {r.rk: r.main_scores for r in some.collect()}
    want = {r.rk: r.main_scores for r in everything.filter("rk in (2, 1030, 2300)").collect()}
    assert got == want


def test_limits_must_be_positive(spark):
    d, _ = synthetic(spark, 5)
    with pytest.raises(ValueError, match="must be positive"):
        window_features(rank_draws(d, ["series"], unique=True), ["series"], [0])


def test_slices_do_not_change_a_chunk(monkeypatch):
    """Counters of one chunk, in one piece and in pieces of seven draws, with targets far apart."""
    import pyarrow as pa

    from drawlake.operators import sliding

    rng = np.random.default_rng(5)
    size = 400
    rk = rng.permutation(np.arange(51, 51 + size))
    # The first fifty draws are borrowed from the chunk before.
    table = pa.table({
        "rk": pa.array(rk), "history_limit": pa.array(np.full(size, 50)),
        "_home": pa.array((rk > 100).astype(np.int64)), "_chunk": pa.array(np.ones(size, np.int64)),
        "_is_target": pa.array(rng.random(size) < 0.2), "main_mask": pa.array(rng.integers(0, 1 << 44, size)),
        "_place": pa.array([None] * size, pa.string()),
    })

    def made():
        count = sliding.chunk_counter(["rk"], {"main": None}, ["rk", "history_count", "main_features"])
        return pa.Table.from_batches(list(count(iter(table.to_batches())))).to_pylist()

    whole = made()
    monkeypatch.setattr(sliding, "SLICE", 7)
    assert made() == whole and len(whole) > 40


def group_sizes(spark, count, limit):
    """Draws per group of a series of ``count`` draws, its busiest group last."""
    from drawlake.operators import sliding

    rk, n = F.col("id") + 1, F.lit(limit).cast("bigint")
    chunks = spark.range(count).select(F.explode(sliding.chunks_of(rk, n)).alias("chunk"))
    last = (count - 1) // (sliding.LONG_CHUNK if limit > sliding.LONG_LIMIT else max(sliding.MIN_CHUNK, 8 * limit))
    return sorted(r["count"] for r in chunks.filter(F.col("chunk") <= last).groupBy("chunk").count().collect())


def test_group_sizes_do_not_grow_with_the_limit(spark):
    from drawlake.operators import sliding

    most = 5 * sliding.LONG_CHUNK + 2
    assert max(max(group_sizes(spark, 2_200_000, n)) for n in (1000, sliding.LONG_LIMIT, 2049, 50_000, 1_000_000)) <= most
    # A shorter window borrows what it spans, at most an eighth of a chunk.
    assert group_sizes(spark, 300_000, 1000)[-1] == 9000


@pytest.mark.parametrize("limit", [65, 66, 100, 127, 128, 129, 200, 333, 640, 1000, 5000])
def test_long_windows_equal_borrowed_ones(spark, monkeypatch, limit):
    """Carried totals at small chunk sizes against windows that borrow all their draws."""
    from drawlake.operators import prefix, sliding

    d, rows = synthetic(spark, 1500)
    other, _ = synthetic(spark, 70, series="t")
    ranked = rank_draws(d.unionByName(other), ["series"], unique=True)
    want = window_features(ranked, ["series"], [limit]).collect()
    monkeypatch.setattr(sliding, "LONG_LIMIT", 64)
    monkeypatch.setattr(sliding, "LONG_CHUNK", 64)
    monkeypatch.setattr(prefix, "SPAN", 5)
    got = window_features(ranked, ["series"], [limit, 3]).filter("history_limit != 3").collect()
    key = lambda r: (r.series, r.rk)
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == len(rows) + 70 - 2
    marked = ranked.withColumn("wanted", F.col("rk").isin(1, 2, 64, 65, 700, 1400))
    some = window_features(marked, ["series"], [limit], target_col="wanted").collect()
    assert sorted(some, key=key) == sorted((r for r in want if r.rk in (2, 64, 65, 700, 1400)), key=key)


def test_carried_totals(spark):
    import random

    from drawlake.operators import prefix

    pick = random.Random(3)
    rows = [("s" if k % 3 else "t", k // 3 + 1 if k % 3 == 0 else None, pick.randrange(1 << 44) & ~1) for k in range(3000)]
    place = 0
    for k, (series, rk, mask) in enumerate(rows):
        if rk is None:
            place += 1
            rows[k] = (series, place, mask)
    frame = spark.createDataFrame(rows, "series string, rk bigint, main_mask bigint")
    got = prefix.carried_totals(frame, ["series"], ("main",), 10)
    seen = got.collect()
    assert len(seen) == 300
    for r in seen:
        before = [(rk, m) for s, rk, m in rows if s == r.series and rk <= r._chunk * 10]
        assert r.main_count == [sum(m >> n & 1 for _, m in before) for n in range(1, 44)]
        assert r.main_last == [max((rk for rk, m in before if m >> n & 1), default=0) for n in range(1, 44)]


def test_window_rankings_order_by_score_then_number(spark):
    from drawlake.operators import sliding

    main = [None, 2.0, 3.0, 2.0, 0.0] + [None] * 38
    bonus = [0.5] * 2 + [None] * 41
    scored = spark.createDataFrame([(1, main, bonus), (2, None, bonus)], "draw_no bigint, main_scores array<double>, bonus_scores array<double>")
    got = {r.draw_no: r[1:] for r in sliding.window_rankings(scored, keep=["draw_no"]).collect()}
    assert got == {1: ([3, 2, 4, 5], 7.0, 1.0), 2: (None, None, 1.0)}
