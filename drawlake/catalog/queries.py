"""Every operator as a query over the generated tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from drawlake import fixtures
from drawlake.functions.arrays import distinct_numbers
from drawlake.functions.rounding import round6
from drawlake.operators import match, project, scores, tickets, validate, weights
from drawlake.operators.rank import latest_per_series, one_per_key, rank_draws
from drawlake.operators.sliding import window_rankings
from drawlake.plans import backtest, grid, predict, reports, tune
from drawlake.session import scratch_path
from drawlake.sources import audit, files, history, known, messages, pages
from drawlake.spec import BONUS_COLUMNS, MAIN_COLUMNS
from drawlake.streaming import dedupe, jobs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SERIES = ["series"]
WINDOW = 100
LIMITS = [20, 100]
SEEDS = [1, 2]
TICKETS = 5
AS_OF = "2026-01-02 03:04:05"


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(build(spark, sf_dir))

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    REGISTRY[build.__name__] = run
    return run


def plain(result: DataFrame) -> DataFrame:
    """Arrays, dates and flags in forms every engine prints alike."""

    def column(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(value.cast("array<string>"), ",")
        if isinstance(field.dataType, (T.DateType, T.TimestampType)):
            return value.cast("string")
        if isinstance(field.dataType, T.BooleanType):
            return value.cast("int")
        if isinstance(field.dataType, T.DoubleType):
            return round6(value)
        return value

    return result.select(*[column(f).alias(f.name) for f in result.schema.fields])


# --- scans and projections -------------------------------------------------


@query
def appearance_counts(spark, sf):
    d = fixtures.draws(spark, sf)
    numbers = d.select("lottery_type", F.explode(distinct_numbers(F.col("main_numbers"))).alias("number"))
    return numbers.groupBy("lottery_type", "number").agg(F.count(F.lit(1)).alias("appearance_count"))


@query
def latest_n_history(spark, sf):
    return history.latest_n(fixtures.draws(spark, sf), WINDOW).select("draw_no", "draw_date", "main_numbers", "bonus_numbers")


@query
def latest_n_by_date(spark, sf):
    d = fixtures.draws(spark, sf)
    newest = [history.latest_n(history.of_type(d, kind), WINDOW, "draw_date", "draw_no") for kind in ("loto6", "loto7")]
    return newest[0].unionByName(newest[1]).select("lottery_type", "draw_no", "draw_date", "main_numbers", "bonus_numbers")


@query
def latest_n_per_series(spark, sf):
    return latest_per_series(fixtures.draws(spark, sf), SERIES, WINDOW).select("series", "draw_no", "draw_idx", "series_size", "main_numbers")


@query
def latest_n_beyond_group_limit(spark, sf):
    """A limit above what the optimiser trims before a shuffle."""
    return latest_per_series(fixtures.draws(spark, sf), SERIES, 1500, span=512).select("series", "draw_no", "draw_idx", "series_size", "rk")


@query
def draw_positions(spark, sf):
    d = rank_draws(fixtures.draws(spark, sf), SERIES, unique=True)
    return d.select("series", "draw_no", "rk", "draw_idx", "series_size")


@query
def draw_positions_sparse(spark, sf):
    """Positions where draw numbers are hashes: no two of them share a bucket."""
    hashed = (F.col("draw_no") * 2654435761) % 4294967296 * 1048576
    d = rank_draws(fixtures.draws(spark, sf).withColumn("draw_no", hashed), SERIES, unique=True, sparse=True)
    return d.select("series", "draw_no", "rk", "draw_idx", "series_size")


@query
def draw_validation_errors(spark, sf):
    d = validate.with_errors(fixtures.faulty_draws(spark, sf))
    return d.select("draw_no", "lottery_type", "errors")


@query
def valid_draws(spark, sf):
    good, _ = validate.split_valid(fixtures.faulty_draws(spark, sf))
    return good.select("draw_no", "lottery_type", "draw_date", "main_numbers", "bonus_numbers")


@query
def unknown_types(spark, sf):
    _, rejected = validate.known_types(fixtures.faulty_draws(spark, sf))
    return rejected.select("draw_no", "lottery_type")


@query
def wide_projection(spark, sf):
    return project.to_wide(fixtures.draws(spark, sf).drop("status", "series"))


@query
def array_projection(spark, sf):
    return project.to_arrays(fixtures.wide_draws(spark, sf)).select("draw_no", "lottery_type", "main_numbers", "bonus_numbers")


@query
def bonus_columns(spark, sf):
    return project.bonus_accessors(fixtures.draws(spark, sf)).select("draw_no", "bonus1", "bonus2")


@query
def target_sets(spark, sf):
    return project.target_sets(fixtures.draws(spark, sf)).select("draw_no", "target_main", "target_bonus")


@query
def row_normalise(spark, sf):
    """Usable rows, and all others with the reason."""
    wide = project.to_wide(fixtures.written_pools(fixtures.faulty_draws(spark, sf)))
    gap = F.when(F.col("draw_no") % 41 == 0, F.lit(None)).otherwise(F.col("n3"))
    text = wide.withColumn("n3", gap).withColumns({c: F.col(c).cast("string") for c in ["draw_no", *MAIN_COLUMNS, *BONUS_COLUMNS]})
    usable, rest = project.normalise_rows(text)
    both = usable.withColumn("reason", F.lit(None).cast("string")).unionByName(rest)
    return both.select("lottery_type", "draw_no", *MAIN_COLUMNS, *BONUS_COLUMNS, "reason")


@query
def sample_rows(spark, sf):
    return fixtures.draws(spark, sf).orderBy("draw_no").limit(3).select("draw_no", "draw_date", "main_numbers", "bonus_numbers")


@query
def range_scan(spark, sf):
    return history.range_scan(fixtures.wide_draws(spark, sf), "LOTO7", 500, 1_000_000_000, 100)


@query
def date_range_scan(spark, sf):
    return history.date_range_scan(fixtures.draws(spark, sf), "1997-03-15", "1999-11-02").select("draw_no", "draw_date")


# --- import ------------------------------------------------------------------


def _indexed(spark, sf):
    """Index lookup for a batch with one number far beyond all others; the index has two parts."""
    table = known.known_numbers(spark, scratch_path(spark, "known"))
    old = fixtures.history(spark, sf)
    for part in range(2):
        table.write(known.index_of(old.filter(F.col("draw_no") % 2 == part)), part)
    batch = fixtures.incoming(spark, sf)
    # The last draw comes once more under a number that a range of the batch would stretch to.
    last = batch.filter("status = 'O'").orderBy(F.desc_nulls_last("draw_no")).limit(1)
    batch = batch.unionByName(last.withColumn("draw_no", F.col("draw_no") + 10**12))
    return known.lookup(table, batch), batch


@query
def existing_keys(spark, sf):
    return history.indexed_keys(*_indexed(spark, sf))


@query
def import_new_rows(spark, sf):
    fresh = history.indexed_new_rows(*_indexed(spark, sf))
    return fresh.select("lottery_type", "draw_no", "draw_date", "main_numbers")


@query
def scanned_keys(spark, sf):
    """Keys already in the history, by a semi-join with a narrowed scan."""
    batch = fixtures.incoming(spark, sf)
    return history.existing_keys(history.near_batch(fixtures.history(spark, sf), batch), batch)


@query
def import_metrics(spark, sf):
    incoming = fixtures.incoming(spark, sf)
    return history.import_metrics(incoming, history.new_rows(fixtures.history(spark, sf), incoming))


@query
def batch_latest_row(spark, sf):
    return history.batch_latest_row(fixtures.incoming(spark, sf)).select("lottery_type", "draw_no", "draw_date", "source_url")


@query
def import_append(spark, sf):
    """Two imports into one table; the second finds everything present."""
    path = scratch_path(spark, "history")
    history.write_history(project.to_wide(fixtures.history(spark, sf).drop("status", "series")), path)
    incoming = project.to_wide(fixtures.incoming(spark, sf).drop("status", "series"))
    history.import_rows(spark, incoming, path)
    history.import_rows(spark, incoming, path)
    return spark.read.parquet(path).select("lottery_type", "draw_no", "n1", "b1")


# --- files ---------------------------------------------------------------------


@query
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    # Some cells hold line breaks, quotes and commas.
    odd = F.concat("source_url", F.lit('\n"x", y'))
    d = fixtures.draws(spark, sf).withColumn("source_url", F.when(F.col("draw_no") % 13 == 0, odd).otherwise(F.col("source_url")))
    files.write_canonical_csv(d, path)
    return files.read_canonical_csv(spark, path)


@query
def csv_mixed_headers(spark, sf):
    """A folder whose files order their columns in two ways."""
    path = scratch_path(spark, "csv-mixed")
    wide = project.to_wide(fixtures.draws(spark, sf).drop("series", "status"))
    for part, columns in enumerate((wide.columns, wide.columns[::-1])):
        rows = wide.filter(F.col("draw_no") % 2 == part).select(*columns)
        rows.write.mode("append").option("header", True).option("nullValue", "\\N").csv(path)
    return files.read_canonical_csv(spark, path, mixed_headers=True)


@query
def jsonl_roundtrip(spark, sf):
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(fixtures.wide_draws(spark, sf).drop("series", "status"), path)
    return files.read_jsonl(spark, path, "loto7")


@query
def legacy_dialect_import(spark, sf):
    """Both older dialects, each with its own column names."""
    shared = {"draw_no": "draw_number", **{f"n{i}": f"number{i}" for i in range(1, 8)}, "source_url": "source"}
    bonus = {"loto6": {"b1": "bonus_number"}, "loto7": {"b1": "bonus_number1", "b2": "bonus_number2"}}
    parts = []
    for kind, names in bonus.items():
        path = scratch_path(spark, "legacy")
        rows = history.of_type(fixtures.wide_draws(spark, sf), kind).drop("series", "status", "lottery_type")
        rows = rows if kind == "loto7" else rows.drop("n7", "b2")
        rows.withColumnsRenamed(shared | names).write.option("header", True).csv(path)
        parts.append(files.read_legacy_csv(spark, path, kind).drop("source_file_name"))
    return parts[0].unionByName(parts[1])


@query
def jsonl_append(spark, sf):
    """JSON lines appended twice; draws that are there already are not repeated."""
    path = scratch_path(spark, "jsonl-table")
    rows = fixtures.wide_draws(spark, sf).drop("series")
    files.append_new_jsonl(spark, rows.filter(F.col("status") == "F").drop("status"), path)
    files.append_new_jsonl(spark, rows.drop("status"), path)
    return files.read_jsonl(spark, path).select("lottery_type", "draw_no", "n1")


@query
def required_fields(spark, sf):
    """Messages by the required fields they lack."""
    good, bad = messages.split_messages(fixtures.messages(spark, sf))
    rows = good.unionByName(bad.drop("reason")).select("event_id", F.nullif("lottery_type", F.lit("")).alias("lottery_type"), "gcs_uri")
    complete, lacking = validate.require_fields(rows, ["lottery_type", "gcs_uri"])
    both = complete.withColumn("missing", F.array().cast("array<string>")).unionByName(lacking)
    return both.groupBy(F.array_join("missing", ",").alias("missing")).agg(F.count(F.lit(1)).alias("row_count"))


@query
def missing_targets(spark, sf):
    """Targets that no draw has: here every target number moved on by one."""
    d = fixtures.draws(spark, sf)
    asked = d.select("series", (F.col("draw_no") + 1).alias("draw_no"))
    return backtest.missing_targets(d, asked, SERIES)


@query
def overwrite_load(spark, sf):
    """Second load replaces the first."""
    path = scratch_path(spark, "table")
    history.overwrite_table(fixtures.wide_draws(spark, sf), path)
    history.overwrite_table(fixtures.wide_draws(spark, sf).filter(F.col("status") == "F"), path)
    return spark.read.parquet(path).select("draw_no", "lottery_type", "n1")


@query
def bulk_append(spark, sf):
    """Append without key check keeps rows that are already there."""
    path = scratch_path(spark, "bulk")
    wide = fixtures.wide_draws(spark, sf).drop("series")
    history.write_history(wide.filter(F.col("status") == "F"), path)
    history.import_rows(spark, wide, path, check_existing=False)
    return spark.read.parquet(path).groupBy("lottery_type", "status").agg(F.count(F.lit(1)).alias("row_count"), F.sum("draw_no").alias("draw_no_sum"))


@query
def partitioned_landing(spark, sf):
    path = scratch_path(spark, "landing")
    history.write_landing(fixtures.wide_draws(spark, sf), path)
    landed = spark.read.parquet(path)
    return landed.groupBy("lottery_type", F.col("draw_block").cast("bigint").alias("draw_block")).agg(F.count(F.lit(1)).alias("row_count"), F.max("draw_no").alias("last_draw_no"))


@query
def landing_latest(spark, sf):
    """The newest draw of each pool, landed twice; the second landing has one pool only and replaces that one."""
    path = scratch_path(spark, "latest")
    wide = fixtures.wide_draws(spark, sf).drop("series", "status")
    history.write_latest(wide.filter(F.col("draw_no") % 2 == 0), path)
    history.write_latest(wide.filter(F.col("draw_no") <= 1000), path)
    history.write_latest(history.of_type(wide, "loto6"), path)
    return spark.read.parquet(path).select("lottery_type", "draw_no", "n1")


# --- scores and weights ----------------------------------------------------------


def _positions(spark, sf):
    return rank_draws(fixtures.draws(spark, sf), SERIES, unique=True)


@query
def number_scores(spark, sf):
    latest = latest_per_series(fixtures.draws(spark, sf), SERIES, WINDOW)
    return scores.rank_scores(scores.number_scores(latest, SERIES), SERIES)


@query
def main_scores(spark, sf):
    return scores.rank_scores(scores.main_scores(_positions(spark, sf), SERIES), SERIES)


@query
def bonus_scores(spark, sf):
    return scores.rank_scores(scores.bonus_scores(_positions(spark, sf), SERIES), SERIES)


@query
def combined_scores(spark, sf):
    both = scores.role_scores(_positions(spark, sf), SERIES)
    return scores.rank_scores(scores.blended_roles(both, SERIES), SERIES)


def _scored(spark, sf, limits=LIMITS):
    return backtest.scored_targets(fixtures.draws(spark, sf), series_cols=SERIES, limits=limits, unique=True)


def _window_rankings(scored):
    """The full ranking of each window by score, and the scores' sum."""
    ranked = window_rankings(scored, keep=["series", "draw_no", "history_limit", "history_count"])
    return ranked.select("series", "draw_no", "history_limit", "history_count", "ranking", "main_total", "bonus_total")


@query
def sliding_scores(spark, sf):
    """All windows of all draws."""
    return _window_rankings(_scored(spark, sf))


@query
def sliding_scores_long(spark, sf):
    """A limit beyond most series: windows that hold all earlier draws."""
    return _window_rankings(_scored(spark, sf, [3000]))


@query
def base_weights(spark, sf):
    main = scores.main_scores(_positions(spark, sf), SERIES)
    return weights.base_weights(main.withColumn("lottery_type", F.substring_index("series", ":", 1)), SERIES)


@query
def blended_weights(spark, sf):
    seven = rank_draws(history.of_type(fixtures.draws(spark, sf), "loto7"), SERIES, unique=True)
    both = scores.role_scores(seven, SERIES).withColumn("lottery_type", F.substring_index("series", ":", 1))
    return weights.blended_weights(both, SERIES)


def _seeded(spark, sf, limits=(WINDOW,), seed=SEEDS[0]):
    return _scored(spark, sf, list(limits)).withColumn("seed", F.lit(seed).cast("bigint"))


RUN = ["series", "draw_no"]


@query
def strategy_tickets(spark, sf):
    return tickets.rank_ticket_rows(_scored(spark, sf, [WINDOW]), RUN)


@query
def weighted_sample(spark, sf):
    return tickets.weighted_sample(_seeded(spark, sf), RUN)


def _ticket_rows(runs):
    return runs.select(*RUN, "lottery_type", F.posexplode("tickets").alias("pos", "ticket")).select(
        *RUN, "lottery_type", (F.col("pos") + 1).alias("ticket_no"), "ticket"
    )


@query
def default_tickets(spark, sf):
    return _ticket_rows(tickets.generate_tickets(_seeded(spark, sf), count=TICKETS, strategy="default"))


@query
def profile_tickets(spark, sf):
    runs = _seeded(spark, sf).filter(F.col("lottery_type") == "loto7")
    return _ticket_rows(tickets.generate_tickets(runs, count=TICKETS, strategy="second_prize_oriented"))


@query
def mixed_tickets(spark, sf):
    """Tickets of every run; runs of an unknown pool come out with their error."""
    made = tickets.generate_tickets(fixtures.written_pools(_seeded(spark, sf)), count=TICKETS, strategy="mixed")
    return made.select(*RUN, "lottery_type", "error", F.posexplode_outer("tickets").alias("pos", "ticket")).select(
        *RUN, "lottery_type", "error", (F.col("pos") + 1).alias("ticket_no"), "ticket"
    )


@query
def excluded_tickets(spark, sf):
    """Default tickets that must differ from those of another seed: none is left of the excluded ones."""
    earlier = tickets.generate_tickets(_seeded(spark, sf), count=TICKETS, strategy="default", drop=())
    again = earlier.withColumnRenamed("ticket_masks", "taken").drop("tickets", "error")
    later = tickets.generate_tickets(again, count=TICKETS, strategy="default", exclude_col="taken")
    pairs = later.join(earlier.select(*RUN, F.col("ticket_masks").alias("before")), RUN)
    return pairs.groupBy("lottery_type").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(F.size("ticket_masks")).alias("tickets"),
        F.sum(F.size(F.array_intersect("ticket_masks", "before"))).alias("repeated"),
    )


# --- backtest ---------------------------------------------------------------------


def _grid(spark, sf, limits=LIMITS, seeds=SEEDS):
    return backtest.run_grid(
        fixtures.draws(spark, sf), series_cols=SERIES, limits=limits, seeds=seeds, count=TICKETS, unique=True
    )


SCOPE = ["lottery_type"]


@query
def prize_tiers(spark, sf):
    judged = match.judged_tickets(_grid(spark, sf, [WINDOW], [1]))
    return judged.groupBy("lottery_type", "main_match", "bonus_match", "prize_tier").agg(F.count(F.lit(1)).alias("tickets"))


@query
def near_miss(spark, sf):
    judged = match.judged_tickets(_grid(spark, sf, [WINDOW], [1]))
    return judged.groupBy("lottery_type", "near_miss_score").agg(F.count(F.lit(1)).alias("tickets"))


@query
def request_errors(spark, sf):
    """Requests whose parameters no run may have, and why."""
    checked = grid.checked_requests(fixtures.grid_requests(spark, sf)).filter(F.size("errors") > 0)
    return checked.select("request_id", "errors")


@query
def requested_grid(spark, sf):
    """Distinct grid points of all usable requests."""
    return grid.requested_grid(fixtures.grid_requests(spark, sf))


@query
def backtest_runs(spark, sf):
    best = backtest.best_of_runs(_grid(spark, sf))
    return best.select(
        "series", F.col("draw_no").alias("target_draw_no"), "history_limit", "history_count", "seed", "ticket_count",
        "best_main_match", "best_bonus_match", "best_near_miss_score", match.tier_label(F.col("best_tier")).alias("best_prize"),
        "first_prize_found", "second_prize_found",
    )


@query
def backtest_tickets(spark, sf):
    judged = match.judged_tickets(_grid(spark, sf, [WINDOW], [1]))
    return judged.select(
        F.col("draw_no").alias("target_draw_no"), "ticket_no", "profile_name", "prediction",
        "main_match", "bonus_match", match.tier_label(F.col("prize_tier")).alias("prize"), "near_miss_score",
    )


@query
def backtest_run_detail(spark, sf):
    """Nested run results with the tickets as JSON-ready text."""
    detail = backtest.run_details(_grid(spark, sf, [WINDOW], [1]), count=TICKETS, strategy="mixed")
    lines = F.transform(
        "tickets",
        lambda t: F.concat_ws(
            " ", t["ticket_no"].cast("string"), F.array_join(t["prediction"].cast("array<string>"), "-"),
            t["main_match"].cast("string"), t["bonus_match"].cast("string"), t["near_miss_score"].cast("string"),
        ),
    )
    return detail.select(
        "target_draw_no", "target_draw_date", "target_main", "target_bonus", "history_count", "prediction_count",
        "strategy", F.array_join(lines, ";").alias("ticket_lines"), "best_prize", "best_near_miss_score",
    )


@query
def backtest_jsonl(spark, sf):
    """Nested run results written as JSON lines and read back."""
    path = scratch_path(spark, "runs")
    detail = backtest.run_details(_grid(spark, sf, [WINDOW], [1]), count=TICKETS, strategy="mixed")
    files.write_jsonl(detail, path)
    back = spark.read.schema(detail.schema).json(path)
    return back.select("target_draw_no", "target_main", "best_prize", F.size("tickets").alias("ticket_count"))


@query
def untrainable_targets(spark, sf):
    return backtest.targets_without_history(fixtures.draws(spark, sf), SERIES)


@query
def prize_counts(spark, sf):
    return reports.prize_counts(match.judged_tickets(_grid(spark, sf)), SCOPE)


@query
def group_summary(spark, sf):
    return reports.group_summary(backtest.best_of_runs(_grid(spark, sf)), SCOPE)


@query
def ticket_summary(spark, sf):
    return reports.ticket_summary(match.judged_tickets(_grid(spark, sf)), SCOPE)


@query
def batch_totals(spark, sf):
    return reports.batch_totals(backtest.best_of_runs(_grid(spark, sf)), SCOPE)


@query
def top_runs(spark, sf):
    return reports.top_runs(backtest.best_of_runs(_grid(spark, sf)))


@query
def hit_examples(spark, sf):
    return reports.hit_examples(match.judged_tickets(_grid(spark, sf)))


# --- tuning and prediction ------------------------------------------------------------


@query
def tune_weights(spark, sf):
    return tune.tune_weights(fixtures.draws(spark, sf), series_cols=SERIES, history_limit=WINDOW, count=TICKETS)


def _runs(spark, sf):
    return predict.prediction_runs(fixtures.draws(spark, sf), series_cols=SERIES, history_limit=WINDOW, count=TICKETS, as_of=AS_OF)


@query
def tuned_prediction_run(spark, sf):
    r = _runs(spark, sf)
    return r.select(
        "execution_id", "series", "history_limit", "history_count", "prediction_count",
        F.array_join(F.transform("predictions", lambda t: F.array_join(t.cast("array<string>"), " ")), ";").alias("predictions"),
        "created_at", "status", "latest_draw_no", "draw_date", "strategy", "seed", "score_weights.*",
        "optimizer_score", "optimizer_rounds",
    )


@query
def prediction_rows(spark, sf):
    return predict.prediction_rows(_runs(spark, sf))


@query
def run_digest(spark, sf):
    return predict.run_digest(_runs(spark, sf))


@query
def recent_runs(spark, sf):
    rows = predict.prediction_rows(_runs(spark, sf))
    newest = history.latest_n(rows, 20, "created_at", "execution_id", "prediction_index")
    return newest.select("execution_id", "prediction_index", "lottery_type", "draw_no", "created_at")


# --- pages ------------------------------------------------------------------------------


@query
def page_months(spark, sf):
    d = fixtures.draws(spark, sf)
    ranges = d.groupBy("lottery_type").agg(F.min("draw_date").alias("start_date"), F.max("draw_date").alias("end_date"))
    return pages.month_spine(spark, ranges)


@query
def missing_months(spark, sf):
    """Months of the harvest range without a page: two before the first draw, and every fifth month, whose pages are taken away."""
    d = fixtures.draws(spark, sf)
    ranges = d.groupBy("lottery_type").agg(F.add_months(F.min("draw_date"), -2).alias("start_date"), F.max("draw_date").alias("end_date"))
    spine = pages.month_spine(spark, ranges)
    landed = fixtures.result_pages(spark, sf).filter(F.coalesce(F.col("month").cast("int") % 5 != 0, F.lit(True)))
    return pages.missing_months(spine, landed).select("lottery_type", "month")


@query
def page_draws(spark, sf):
    found = pages.page_draws(fixtures.result_pages(spark, sf))
    return found.select("lottery_type", "month", "draw_no", "draw_date", "main_numbers", "bonus_numbers", "errors")


@query
def page_latest(spark, sf):
    found = pages.latest_page_draws(fixtures.latest_pages(spark, sf))
    return found.select("lottery_type", "draw_no", "draw_date", "main_numbers", "bonus_numbers", "errors")


@query
def page_strict(spark, sf):
    """Draws of pages without any invalid draw; here the newest-first pages, read row by row."""
    rows = fixtures.result_pages(spark, sf)
    # A number that no pool has, on every page whose key is even.
    spoilt = F.when(F.pmod("page_id", F.lit(2)) == 0, F.concat(F.lit("<tr><td>第1回 2001/01/01</td><td>1 2 3 4 5 77 7</td><td>8 9</td></tr>"), "html"))
    found = pages.page_draws(rows.withColumn("html", F.coalesce(spoilt, "html")), strict_page=True)
    return found.groupBy("lottery_type").agg(F.sum(F.size("errors")).cast("bigint").alias("errors"), (F.count(F.lit(1)) > 0).alias("some"))


@query
def unknown_pool_pages(spark, sf):
    return pages.unknown_pool_pages(fixtures.result_pages(spark, sf))


@query
def page_dedupe(spark, sf):
    found = pages.harvest(fixtures.result_pages(spark, sf, provisional=True), "1996-02-10", "2000-09-30")
    return found.select("lottery_type", "draw_no", "draw_date", "main_numbers", "bonus_numbers")


@query
def harvest_to_csv(spark, sf):
    path = scratch_path(spark, "harvest")
    files.save_backfill(pages.harvest(fixtures.result_pages(spark, sf)), path)
    return files.read_canonical_csv(spark, path).drop("source_url")


# --- messages and streams ------------------------------------------------------------------


@query
def message_decode(spark, sf):
    good, _ = messages.split_messages(fixtures.messages(spark, sf))
    return good.select("event_id", "execution_id", "lottery_type", "gcs_uri", "bucket", "object", "draw_no", "notify")


@query
def dead_letters(spark, sf):
    _, bad = messages.split_messages(fixtures.messages(spark, sf))
    return bad.select("event_id", "reason")


@query
def message_forms(spark, sf):
    """Messages that name file, flag and execution in every accepted way."""
    good, _ = messages.split_messages(fixtures.odd_messages(spark, sf), default_bucket="spare")
    return good.select("event_id", "execution_id", "lottery_type", "gcs_uri", "bucket", "object", "draw_no", "notify")


@query
def dead_letter_reasons(spark, sf):
    _, bad = messages.split_messages(fixtures.odd_messages(spark, sf), default_bucket="spare")
    return bad.select("event_id", "reason")


@query
def prediction_requests(spark, sf):
    """The same messages at the prediction stage, which needs no file; the flag counts as set where it is missing."""
    good, _ = messages.split_messages(fixtures.odd_messages(spark, sf), need_uri=False, notify_default=False)
    return good.groupBy("lottery_type", "notify").agg(F.count(F.lit(1)).alias("row_count"))


def _landed(spark, frame, label, parts=None):
    """Rows as landed files: as they are partitioned, or dealt out anew. Several tasks can read a large file."""
    path = scratch_path(spark, label)
    (frame.repartition(parts) if parts else frame).write.option("parquet.block.size", 16 << 20).parquet(path)
    return path


def _import_stream(spark, sf):
    incoming = fixtures.incoming(spark, sf).drop("series", "status")
    path = _landed(spark, incoming, "incoming")
    out = {name: scratch_path(spark, name) for name in ("table", "outbox", "audit", "checkpoint")}
    stream = jobs.file_stream(spark, path, incoming.schema, files_per_batch=2)
    jobs.import_stream(stream, fixtures.history(spark, sf), **out).awaitTermination()
    return out


@query
def stream_import(spark, sf):
    table = _import_stream(spark, sf)["table"]
    rows = jobs.imported(spark, table, fixtures.incoming(spark, sf).drop("series", "status").schema).read()
    return rows.select("lottery_type", "draw_no", "draw_date", "main_numbers", "bonus_numbers")


@query
def stage_outbox(spark, sf):
    out = spark.read.parquet(_import_stream(spark, sf)["outbox"])
    return out.groupBy("lottery_type").agg(
        F.sum("total_rows").alias("total_rows"), F.sum("inserted_rows").alias("inserted_rows"),
        F.sum("skipped_rows").alias("skipped_rows"), F.max("draw_no").alias("draw_no"),
    )


def _deduped(spark, sf, parts, per_batch):
    sent = fixtures.redelivered(fixtures.messages(spark, sf))
    path = _landed(spark, sent, "messages", parts)
    table, letters, checkpoint = (scratch_path(spark, n) for n in ("deduped", "letters", "checkpoint"))
    stream = jobs.file_stream(spark, path, sent.schema, files_per_batch=per_batch)
    dedupe.dedupe_stream(stream, table=table, dead_letters=letters, checkpoint=checkpoint).awaitTermination()
    return spark.read.parquet(table)


@query
def stream_dedupe(spark, sf):
    return _deduped(spark, sf, None, 2).select("execution_id")


@query
def stream_dedupe_regrouped(spark, sf):
    """The same messages in other files and batches send the same."""
    return _deduped(spark, sf, 3, 1).select("execution_id")


@query
def stream_replay(spark, sf):
    """A stream that starts over without its checkpoint repeats its batches; each replaces itself."""
    incoming = fixtures.incoming(spark, sf).drop("series", "status")
    path = _landed(spark, incoming, "incoming")
    out = {name: scratch_path(spark, name) for name in ("table", "outbox", "audit")}
    for _ in range(2):
        stream = jobs.file_stream(spark, path, incoming.schema, files_per_batch=2)
        checkpoint = scratch_path(spark, "checkpoint")
        jobs.import_stream(stream, fixtures.history(spark, sf), checkpoint=checkpoint, **out).awaitTermination()
    return jobs.imported(spark, out["table"], incoming.schema).read().select("lottery_type", "draw_no")


@query
def import_to_digest(spark, sf):
    """From landed files to the digest texts: the import stage's outbox is the prediction stage's stream.

    All files are one batch, as wide as the rows come in.
    """
    incoming = fixtures.incoming(spark, sf).drop("series", "status")
    known = fixtures.history(spark, sf).select(incoming.columns)
    path = _landed(spark, incoming, "incoming")
    first = {name: scratch_path(spark, name) for name in ("table", "outbox", "audit", "checkpoint")}
    jobs.import_stream(jobs.file_stream(spark, path, incoming.schema, files_per_batch=None), known, **first).awaitTermination()
    draws = known.unionByName(jobs.imported(spark, first["table"], incoming.schema).read())
    second = {name: scratch_path(spark, name) for name in ("runs", "outbox", "dead_letters", "audit", "checkpoint")}
    asked = jobs.file_stream(spark, first["outbox"], jobs.OUTBOX).select("value")
    jobs.predict_stream(asked, draws, history_limit=60, count=2, as_of=AS_OF, **second).awaitTermination()
    digest = spark.read.parquet(second["outbox"])
    lines = F.split("message", "\n")
    # The lines after the blank one are the tickets.
    return digest.select(
        "execution_id", "lottery_type", "status",
        F.array_join(F.slice(lines, 1, 6), "|").alias("header"), (F.size(lines) - 7).alias("tickets"),
    )


@query
def stream_predictions(spark, sf):
    """Prediction stage over queued messages: every execution has one run, undecodable ones a FAILED audit row."""
    sent = fixtures.messages(spark, sf)
    path = _landed(spark, sent, "messages")
    out = {name: scratch_path(spark, name) for name in ("runs", "outbox", "dead_letters", "audit", "checkpoint")}
    stream = jobs.file_stream(spark, path, sent.schema)
    draws = fixtures.draws(spark, sf).drop("series")
    jobs.predict_stream(stream, draws, history_limit=60, count=2, as_of=AS_OF, **out).awaitTermination()
    made = spark.read.parquet(out["runs"]).select("lottery_type", F.col("status"), F.size("predictions").alias("tickets"))
    noted = spark.read.parquet(out["audit"]).filter("error_type = 'dead_letter'").select(
        F.lit("-").alias("lottery_type"), "status", F.lit(0).alias("tickets")
    )
    return made.unionByName(noted).groupBy("lottery_type", "status").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("tickets").alias("tickets")
    )


@query
def prediction_sink(spark, sf):
    """Ticket rows appended to the flat table and read back."""
    path = scratch_path(spark, "prediction-rows")
    predict.append_prediction_rows(_runs(spark, sf), path)
    rows = spark.read.parquet(path)
    return rows.select("execution_id", "prediction_index", "n1", "n6", "n7", "draw_no", "lottery_type")


@query
def message_encode(spark, sf):
    """Decoded messages encoded again as JSON values."""
    good, _ = messages.split_messages(fixtures.messages(spark, sf))
    return messages.encode(good, ["execution_id", "lottery_type", "draw_no"]).select(F.col("value").cast("string").alias("value"))


@query
def stream_dedupe_stateful(spark, sf):
    sent = fixtures.messages(spark, sf)
    path = _landed(spark, sent, "messages")
    table, checkpoint = (scratch_path(spark, n) for n in ("deduped", "checkpoint"))
    stream = jobs.file_stream(spark, path, sent.schema, files_per_batch=2)
    jobs.dedupe_stateful(stream, table=table, checkpoint=checkpoint).awaitTermination()
    return spark.read.parquet(table).select("execution_id")


def _audit_table(spark, sf):
    """Audit table of all messages, undecodable ones included as FAILED."""
    path = scratch_path(spark, "audit")
    good, bad = messages.split_messages(fixtures.messages(spark, sf))
    rows = good.select(
        "execution_id", F.concat(F.lit("stage_"), "event_type").alias("function_name"), "lottery_type",
        F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"),
        F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error_detail"),
        F.col("object").alias("gcs_object"), "draw_no", F.col("event_time").alias("executed_at"),
    )
    lost = jobs.refused(bad.withColumn("execution_id", F.concat(F.lit("event-"), "event_id")), "decode")
    timed = lost.drop("executed_at").withColumn("gcs_object", F.lit(None).cast("string")).withColumn(
        "executed_at", F.to_timestamp(F.lit(AS_OF))
    )
    audit.append_audit(rows.unionByName(timed), path)
    return spark.read.parquet(path)


@query
def audit_trail(spark, sf):
    return _audit_table(spark, sf).select(
        "execution_id", "stage", "status", "gcs_object", "draw_no", "executed_date", "error_type", "error_detail"
    )


@query
def audit_trace(spark, sf):
    """Stages of the execution with the smallest id, in time order."""
    rows = _audit_table(spark, sf)
    first = rows.agg(F.min("execution_id")).first()[0]
    return audit.trace(rows, first).select("execution_id", "stage", "status", F.date_format("executed_at", "yyyy-MM-dd HH:mm:ss").alias("executed_at"))


@query
def unsent_messages(spark, sf):
    """Messages without a run; here purchases count as already run."""
    good, _ = messages.split_messages(fixtures.messages(spark, sf))
    runs = good.filter(F.col("event_type") == "purchase").select("execution_id")
    return jobs.unsent(good, runs).select("execution_id")


@query
def requested_runs(spark, sf):
    """One tuned run per queued execution, pools as series; requests for a pool without draws fail visibly."""
    good, _ = messages.split_messages(fixtures.messages(spark, sf))
    asked = one_per_key(good.select("execution_id", "lottery_type", "draw_no", "draw_date", "notify"), ["execution_id"])
    strange = asked.filter(F.col("draw_no") % 50 == 0).withColumns(
        {"execution_id": F.concat("execution_id", F.lit("-x")), "lottery_type": F.lit("mini")}
    )
    asked = asked.unionByName(strange)
    runs = predict.prediction_runs(
        fixtures.draws(spark, sf).drop("series"), series_cols=["lottery_type"], history_limit=WINDOW, count=TICKETS, as_of=AS_OF, requests=asked
    )
    lines = F.transform("predictions", lambda t: F.array_join(t.cast("array<string>"), " "))
    return runs.select(
        "execution_id", "lottery_type", "latest_draw_no", "seed", F.array_join(lines, ";").alias("predictions"), "status",
        F.col("error").isNotNull().alias("has_error"),
    )
