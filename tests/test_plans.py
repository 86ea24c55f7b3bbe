import pytest
from pyspark.sql import functions as F

from drawlake import fixtures
from drawlake.operators.match import judged_tickets, near_miss, prize_tier
from drawlake.plans import backtest, predict, reports, tune
from drawlake.session import scratch_path
from drawlake.spec import check_range


def outcomes(spark, kind):
    pairs = [(kind, m, b) for m in range(8) for b in range(3)]
    df = spark.createDataFrame(pairs, "k string, m int, b int")
    k, m, b = F.col("k"), F.col("m"), F.col("b")
    return {(r.m, r.b): (r.t, r.p) for r in df.select("m", "b", prize_tier(k, m, b).alias("t"), near_miss(k, m, b).alias("p")).collect()}


def test_tiers_and_points(spark):
    six, seven = outcomes(spark, "loto6"), outcomes(spark, "loto7")
    assert [six[x] for x in ((6, 0), (5, 1), (5, 0), (4, 1), (3, 0), (2, 1))] == [(1, 5000), (2, 3000), (3, 1500), (4, 500), (5, 100), (0, 0)]
    assert [seven[x] for x in ((7, 0), (6, 2), (6, 0), (5, 1), (5, 0), (4, 1), (4, 0), (3, 1), (3, 0))] == [
        (1, 5000), (2, 3000), (3, 1500), (4, 800), (4, 500), (5, 200), (5, 100), (6, 50), (0, 0)]


def test_targets_can_be_chosen_and_missing_ones_are_reported(spark, small):
    d = fixtures.draws(spark, small)
    every = backtest.run_grid(d, series_cols=["series"], limits=[50], seeds=[7], unique=True)
    chosen = d.filter("draw_no in (900, 1201)").select("series", "draw_no")
    asked = chosen.unionByName(spark.createDataFrame([("loto6:none", 5)], "series string, draw_no bigint"))
    some = backtest.run_grid(d, series_cols=["series"], limits=[50], seeds=[7], targets=asked, unique=True)
    pick = lambda runs: {r.draw_no: r.tickets for r in runs.filter("draw_no in (900, 1201)").collect()}
    assert some.count() == 2 and pick(some) == pick(every)
    assert [r.draw_no for r in backtest.missing_targets(d, asked, ["series"]).collect()] == [5]


def test_best_of_run_is_its_best_ticket(spark, small):
    runs = backtest.run_grid(fixtures.draws(spark, small), series_cols=["series"], limits=[20], seeds=[1], unique=True)
    best = backtest.best_of_runs(runs).select("series", "draw_no", "best_near_miss_score", "best_main_match", "best_bonus_match", "best_tier")
    top = judged_tickets(runs).groupBy("series", "draw_no").agg(F.max(F.struct("near_miss_score", "main_match", "bonus_match", "prize_tier")).alias("t"))
    joined = best.join(top, ["series", "draw_no"])
    assert joined.count() == 1490
    assert joined.filter("struct(best_near_miss_score, best_main_match, best_bonus_match, best_tier) <> t").count() == 0


def test_a_profile_only_grid_falls_back_for_the_six_pool(spark, small):
    runs = backtest.run_grid(fixtures.draws(spark, small), series_cols=["series"], limits=[20], seeds=[1], strategy="second_prize_oriented", unique=True)
    assert runs.filter("error is not null").count() == 0 and runs.count() == 1490


def test_prize_counts_list_all_tiers(spark, small):
    runs = backtest.run_grid(fixtures.draws(spark, small), series_cols=["series"], limits=[20], seeds=[1], unique=True)
    rows = reports.prize_counts(judged_tickets(runs), ["lottery_type"]).orderBy("lottery_type", "position").collect()
    assert [r.prize for r in rows[:7]] == ["1等相当", "2等相当", "3等相当", "4等相当", "5等相当", "6等相当", "該当なし"]
    assert sum(r.tickets for r in rows) == 1490 * 5


def drifting(spark, count):
    """A history by rule: draw k holds every fifth number of the pool from k squared on."""
    rows = spark.range(1, count + 1).select(F.lit("s").alias("series"), F.lit("loto7").alias("lottery_type"), F.col("id").alias("draw_no"))
    main = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: ((F.col("draw_no") * F.col("draw_no") + i * 5) % 37 + 1).cast("int"))
    return rows.withColumns({"main_numbers": main, "bonus_numbers": F.array(F.lit(1), F.lit(2))})


def test_tuning_evaluates_rounds_and_short_histories_keep_defaults(spark):
    tuned = tune.tune_weights(drifting(spark, 110), series_cols=["series"], history_limit=110).first()
    assert tuned.optimizer_rounds == 11 and tuned.optimizer_score > 0
    assert (tuned.frequency, tuned.recent, tuned.recency) in set(tune.GRID)
    short = tune.tune_weights(drifting(spark, 25), series_cols=["series"], history_limit=110).first()
    assert short[:] == ("s", 1.0, 2.0, 1.5, 0.0, 0)
    own = tune.tune_weights(drifting(spark, 25), series_cols=["series"], history_limit=110, backtest_rounds=3, min_train_draws=10)
    assert own.first().optimizer_rounds == 3
    with pytest.raises(ValueError):
        tune.tune_weights(drifting(spark, 20), series_cols=["series"], history_limit=0)


def test_requests_without_draws_fail_visibly(spark, small):
    d = fixtures.draws(spark, small).drop("series").filter("lottery_type = 'loto6'")
    asked = spark.createDataFrame(
        [("a", "loto6"), ("b", "loto7"), ("c", "mini")], "execution_id string, lottery_type string"
    ).selectExpr("*", "cast(null as bigint) draw_no", "cast(null as date) draw_date", "cast(null as boolean) notify")
    runs = predict.prediction_runs(d, series_cols=["lottery_type"], history_limit=60, count=2, as_of="2026-01-02 03:04:05", requests=asked)
    got = {r.execution_id: (r.status, r.error) for r in runs.collect()}
    assert got["a"] == ("SUCCESS", None)
    assert got["b"] == ("FAILED", predict.NO_DRAWS) and got["c"][0] == "FAILED" and got["c"][1]


def test_prediction_run_payload(spark, small):
    d = fixtures.draws(spark, small)
    options = {"series_cols": ["series"], "history_limit": 60, "count": 3, "as_of": "2026-01-02 03:04:05"}
    runs = predict.prediction_runs(d, **options, notify=False).cache()
    assert runs.count() == 10 and {r.status for r in runs.collect()} == {"DRY_RUN"}
    newest = {r.series: r.n for r in d.groupBy("series").agg(F.max("draw_no").alias("n")).collect()}
    assert all(r.latest_draw_no == newest[r.series] and r.history_count == 60 for r in runs.collect())
    rows = predict.prediction_rows(runs).collect()
    assert len(rows) == 30 and {r.prediction_index for r in rows} == {1, 2, 3}
    assert all((r.n7 is None) == (r.lottery_type == "loto6") and not r.message_sent for r in rows)
    again = predict.prediction_runs(d, **options, notify=False)
    assert again.select("execution_id", "predictions").exceptAll(runs.select("execution_id", "predictions")).isEmpty()
    text = predict.run_digest(runs.filter("lottery_type = 'loto7'")).first().message.split("\n")
    assert text[0] == "LOTO7 予想" and text[2] == "実行日時: 2026-01-02 12:04:05" and text[7].startswith("1口目: ")


def test_prediction_rows_of_hand_payloads(spark):
    schema = ("execution_id string, lottery_type string, latest_draw_no bigint, draw_date date, status string, "
              "created_at timestamp, predictions array<array<int>>")
    make = lambda *rows: spark.createDataFrame([(*r[:3], None, r[3], None, r[4]) for r in rows], schema)
    rows = predict.prediction_rows(make(
        ("e1", "loto6", 1234, "SUCCESS", [[1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12]]),
        ("e2", "loto7", 567, "DRY_RUN", [[1, 2, 3, 4, 5, 6, 7]]),
        ("e3", "loto6", None, "FAILED", []),
    )).collect()
    assert [(r.execution_id, r.prediction_index, r.n1, r.n6, r.n7, r.message_sent) for r in rows] == [
        ("e1", 1, 1, 6, None, True), ("e1", 2, 7, 12, None, True), ("e2", 1, 1, 6, 7, False)]
    with pytest.raises(Exception, match="six numbers"):
        predict.prediction_rows(make(("e", "loto6", 1, "SUCCESS", [[1, 2]]))).collect()


def test_parameter_ranges_and_scratch_folder(spark):
    assert check_range(3, 5, "seed") == [3, 4, 5]
    with pytest.raises(ValueError):
        check_range(5, 3, "seed")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    assert shared is None or first.startswith(shared)
