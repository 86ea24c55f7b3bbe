from pyspark.sql import Window, functions as F

from drawlake import fixtures
from drawlake.operators.rank import latest_per_series, one_per_key, rank_draws


def test_rank_equals_plain_window(spark, small):
    d = fixtures.draws(spark, small)
    plain = d.withColumn("want", F.row_number().over(Window.partitionBy("series").orderBy("draw_no")))
    # A tiny span exercises many buckets.
    for span in (3, 64, 1 << 18):
        got = rank_draws(d, ["series"], unique=True, span=span)
        joined = got.join(plain.select("draw_no", "want"), "draw_no")
        assert joined.count() == d.count()
        assert joined.filter("rk <> want").count() == 0
        assert joined.filter("draw_idx <> series_size - rk").count() == 0


def test_rank_removes_copies_first(spark):
    rows = spark.range(0, 3000).select(
        F.lit("a").alias("series"), F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id")).alias("draw_no"),
        F.array(F.lit(1)).alias("main_numbers"),
    )
    got = rank_draws(rows, ["series"])
    assert got.count() == 2001
    assert got.agg(F.max("rk"), F.countDistinct("rk")).first()[:] == (2001, 2001)


def test_rank_keeps_a_hot_series_in_bounded_windows(spark, small):
    plan = rank_draws(fixtures.draws(spark, small), ["series"], unique=True)._jdf.queryExecution().toString()
    assert "windowspecdefinition(series" in plan
    ordered = [line for line in plan.splitlines() if "row_number()" in line]
    assert ordered and all("_bucket" in line for line in ordered)


def test_one_per_key_takes_newest(spark):
    rows = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (2, 1, "x")], "k int, v int, t string")
    assert sorted(map(tuple, one_per_key(rows, ["k"], newest="v").collect())) == [(1, 9, "new"), (2, 1, "x")]


def test_latest_per_series_sorts_buckets_only(spark, small):
    d = fixtures.draws(spark, small)
    plain = d.withColumn("want", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("draw_no"))))
    for limit, span in ((20, 64), (2000, 64), (20, 1 << 18)):
        got = latest_per_series(d, ["series"], limit, span=span)
        want = plain.filter(F.col("want") <= limit)
        assert got.count() == want.count()
        assert got.join(want.select("draw_no", "want"), "draw_no").filter("draw_idx + 1 <> want or rk <> series_size - draw_idx").count() == 0
        plan = got._jdf.queryExecution().toString()
        assert all("_bucket" in line for line in plan.splitlines() if "row_number()" in line)


def test_rows_without_order_are_left_out(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None)], "series string, draw_no int")
    assert [r.draw_no for r in latest_per_series(rows, ["series"], 5).collect()] == [1]


def test_sparse_positions_equal_dense_ones(spark):
    import random

    pick = random.Random(5)
    rows = [("s" if pick.random() < 0.7 else "t", pick.choice([pick.randrange(10), pick.randrange(1 << 62)])) for _ in range(800)]
    rows += [("u", 5), ("u", None), (None, 4), (None, 9)]
    frame = spark.createDataFrame(rows, "series string, draw_no bigint").repartition(6)
    got = {(r.series, r.draw_no): (r.rk, r.draw_idx, r.series_size) for r in rank_draws(frame, ["series"], sparse=True).collect() if r.series}
    want = {}
    for series in "stu":
        own = sorted({n for s, n in rows if s == series and n is not None})
        want |= {(series, n): (k + 1, len(own) - 1 - k, len(own)) for k, n in enumerate(own)}
    assert got == want
    assert rank_draws(frame.limit(0), ["series"], sparse=True).count() == 0
