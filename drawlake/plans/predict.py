"""Tuned prediction run for the next draw of every series, and its output rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawlake.operators.rank import latest_per_series
from drawlake.operators.scores import BONUS_FACTORS, ScoreWeights
from drawlake.operators.sliding import task_count, window_features
from drawlake.operators.tickets import NO_SCORES, generate_tickets
from drawlake.plans.tune import WEIGHT_COLUMNS, score_features, tune_weights
from drawlake.session import written
from drawlake.spec import MAIN_COLUMNS, check_limits, check_ticket_count


REQUEST_FIELDS = {
    "_execution_id": "string", "_draw_no": "bigint", "_draw_date": "date", "_notify": "boolean",
}


# Most series whose scores, under a kilobyte each, are broadcast to the requests.
BROADCAST_SERIES = 20_000
NO_DRAWS = "the requested series has no draws"


def stable_seed(key: Column) -> Column:
    """28-bit seed from a key, so that a replayed run repeats its tickets."""
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("bigint")


def next_draw_features(latest: DataFrame, series_cols: list[str], history_limit: int) -> DataFrame:
    """Features over the newest ``history_limit`` draws, one row per series.

    The draw to predict is added as an empty draw after the newest one.
    """
    extra = [c for c in ("lottery_type",) if c not in series_cols]
    coming = latest.groupBy(*series_cols, *extra).agg(
        (F.max("rk") + 1).alias("rk"),
        F.max("draw_no").alias("latest_draw_no"),
        F.max_by("draw_date", "draw_no").alias("latest_draw_date"),
        F.lit(None).cast("array<int>").alias("main_numbers"),
        F.lit(None).cast("array<int>").alias("bonus_numbers"),
    )
    empty = F.array().cast("array<int>")
    rows = latest.select(
        *series_cols, *extra, "rk", "main_numbers", "bonus_numbers",
        F.lit(None).cast("bigint").alias("latest_draw_no"),
        F.lit(None).cast("date").alias("latest_draw_date"),
    ).unionByName(
        coming.withColumn("main_numbers", empty).withColumn("bonus_numbers", empty)
    )
    return window_features(
        rows, series_cols, [history_limit], keep=[*extra, "latest_draw_no", "latest_draw_date"]
    ).filter(F.col("latest_draw_no").isNotNull())


def prediction_runs(
    draws: DataFrame,
    *,
    series_cols: list[str],
    history_limit: int = 100,
    count: int = 5,
    strategy: str = "mixed",
    notify: bool = True,
    as_of: str,
    requests: DataFrame | None = None,
) -> DataFrame:
    """Tune, score and generate for every series; one run payload per series.

    ``as_of`` is the run's timestamp text (UTC); together with the series it
    fixes execution_id and seed, which makes a replay idempotent.

    With ``requests`` (series, execution_id, draw_no, draw_date, notify) one run
    is made per request; its non-NULL values override the derived ones. A run that
    can't be made, also for want of draws, is FAILED and says why in ``error``.
    """
    check_limits([history_limit])
    check_ticket_count(count)
    # One pass over the history: the newest draws are few and feed the tuning, the features and the defaults.
    latest = written(latest_per_series(draws, series_cols, history_limit), "latest")
    tuned = tune_weights(draws, series_cols=series_cols, history_limit=history_limit, count=count, latest=latest)
    features = next_draw_features(latest, series_cols, history_limit).join(tuned, series_cols)
    defaults = ScoreWeights()
    main_weights = {
        **{w: F.col(w) for w in ("frequency", "recent", "recency")},
        "absence": F.lit(defaults.absence),
        "repeat_penalty": F.lit(defaults.repeat_penalty),
    }
    names = {w: f"tuned_{w}" for w in ("frequency", "recent", "recency")}
    weighted = features.withColumns(
        {**{names[w]: F.col(w) for w in names}, **main_weights}
    )
    main = score_features(weighted, "main_features", "main_scores")
    bonus = score_features(
        main.withColumns({w: F.col(w) * F.lit(BONUS_FACTORS[w]) for w in WEIGHT_COLUMNS}),
        "bonus_features",
        "bonus_scores",
    ).withColumn("bonus_scores", F.when(F.col("lottery_type") == "loto7", F.col("bonus_scores")))
    # Scores belong to the series; only the tickets are made per request.
    if requests is None:
        asked = bonus.select(
            "*",
            *[F.lit(None).cast(t).alias(c) for c, t in REQUEST_FIELDS.items()],
        )
    else:
        # Few series, many requests: spreading the small request rows spreads the ticket work.
        spread = requests.select(
            *series_cols,
            *[F.col(c.removeprefix("_")).cast(t).alias(c) for c, t in REQUEST_FIELDS.items()],
        ).repartition(task_count(requests), "_execution_id")
        # One row per series: broadcast while there are few, else joined by series. A request
        # whose series has no draws keeps no scores and fails visibly.
        scored = written(bonus, "series-scores")
        few = scored.count() <= BROADCAST_SERIES
        asked = spread.join(F.broadcast(scored) if few else scored, series_cols, "left")
    derived_id = F.md5(F.concat_ws("|", *series_cols, F.lit(as_of)))
    keyed = (
        asked.withColumn("execution_id", F.coalesce("_execution_id", derived_id))
        .withColumn("latest_draw_no", F.coalesce("_draw_no", "latest_draw_no"))
        .withColumn("latest_draw_date", F.coalesce("_draw_date", "latest_draw_date"))
        .withColumn("_notify", F.coalesce("_notify", F.lit(notify)))
        .withColumn("seed", stable_seed(F.col("execution_id")))
        .drop("_execution_id", "_draw_no", "_draw_date")
    )
    runs = generate_tickets(keyed, count=count, strategy=strategy)
    return runs.select(
        "execution_id",
        *series_cols,
        *[c for c in ("lottery_type",) if c not in series_cols],
        F.lit(history_limit).alias("history_limit"),
        "history_count",
        F.size("tickets").alias("prediction_count"),
        F.col("tickets").alias("predictions"),
        F.to_timestamp(F.lit(as_of)).alias("created_at"),
        F.when(F.col("error").isNotNull(), "FAILED")
        .when(F.col("_notify"), "SUCCESS")
        .otherwise("DRY_RUN")
        .alias("status"),
        "latest_draw_no",
        F.col("latest_draw_date").alias("draw_date"),
        F.lit(strategy).alias("strategy"),
        "seed",
        F.struct(*[F.col(names[w]).alias(w) for w in names]).alias("score_weights"),
        "optimizer_score",
        "optimizer_rounds",
        F.when(F.col("history_count").isNull(), F.coalesce(F.nullif("error", F.lit(NO_SCORES)), F.lit(NO_DRAWS)))
        .otherwise(F.col("error"))
        .alias("error"),
    )


def append_prediction_rows(runs: DataFrame, path: str) -> None:
    """Append the ticket rows of runs to the flat prediction table."""
    prediction_rows(runs).write.mode("append").partitionBy("lottery_type").parquet(path)


def prediction_rows(runs: DataFrame) -> DataFrame:
    """One row per ticket, index from 1; n7 only for the 7-pick pool.

    Runs without tickets give no rows; a ticket with fewer than six numbers
    fails the job.
    """
    ticket = F.col("ticket")
    checked = F.when(
        F.size(ticket) < 6, F.raise_error(F.lit("a ticket needs six numbers or more"))
    ).otherwise(ticket)
    rows = runs.select(
        "execution_id",
        "lottery_type",
        F.col("latest_draw_no").alias("draw_no"),
        "draw_date",
        F.posexplode("predictions").alias("_pos", "_ticket"),
        (F.upper(F.coalesce("status", F.lit(""))) == "SUCCESS").alias("message_sent"),
        "created_at",
    ).withColumn("ticket", F.col("_ticket"))
    rows = rows.withColumn("ticket", checked)
    numbers = [F.get("ticket", F.lit(i)).alias(c) for i, c in enumerate(MAIN_COLUMNS[:6])]
    seventh = F.when(F.col("lottery_type") == "loto7", F.get("ticket", F.lit(6))).alias("n7")
    return rows.select(
        "execution_id", "lottery_type", "draw_no", "draw_date",
        (F.col("_pos") + 1).alias("prediction_index"), *numbers, seventh,
        "message_sent", "created_at",
    )


def run_digest(runs: DataFrame, *, zone: str = "Asia/Tokyo") -> DataFrame:
    """Outbox text of each run: a header and one line per ticket (wording: fixed values)."""
    number = F.when(
        F.col("latest_draw_no").isNotNull(), F.concat(F.lit("第"), "latest_draw_no", F.lit("回"))
    ).otherwise("回号不明")
    local_time = F.date_format(F.from_utc_timestamp("created_at", zone), "yyyy-MM-dd HH:mm:ss")
    lines = F.transform(
        "predictions",
        lambda t, i: F.concat(
            (i + 1).cast("string"), F.lit("口目: "), F.array_join(t.cast("array<string>"), " ")
        ),
    )
    header = F.array(
        F.concat(F.upper("lottery_type"), F.lit(" 予想")),
        F.concat(F.lit("回号: "), number),
        F.concat(F.lit("実行日時: "), local_time),
        F.concat(F.lit("対象履歴: 直近"), "history_count", F.lit("件")),
        F.concat(F.lit("予想口数: "), F.size("predictions"), F.lit("口")),
        F.concat(F.lit("戦略: "), "strategy"),
        F.lit(""),
    )
    return runs.select(
        "execution_id",
        "lottery_type",
        "status",
        F.array_join(F.concat(header, lines), "\n").alias("message"),
    )
