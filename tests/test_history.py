import pytest
from pyspark.sql import functions as F

from drawlake import fixtures
from drawlake.operators import project
from drawlake.sources import audit, history


def keyed(spark, numbers, kind="loto6"):
    return spark.createDataFrame([(kind, n, f"v{i}") for i, n in enumerate(numbers)], "lottery_type string, draw_no bigint, note string")


def test_new_rows_skip_known_unnumbered_and_repeated(spark):
    known = keyed(spark, [1, 2, 3])
    batch = keyed(spark, [3, 4, 4, None, 5])
    assert sorted(r.draw_no for r in history.new_rows(known, batch).collect()) == [4, 5]
    assert sorted(r.draw_no for r in history.new_rows(known, batch, dedupe=False).collect()) == [4, 4, 5]
    other = keyed(spark, [3], kind="loto7")
    assert [r.lottery_type for r in history.new_rows(known, other).collect()] == ["loto7"]


def test_keys_are_found_and_pruned_by_range(spark):
    known, batch = keyed(spark, range(1, 50)), keyed(spark, range(40, 60))
    assert history.existing_keys(known, batch).count() == 10
    assert sorted(r.draw_no for r in history.near_batch(known, batch).collect()) == list(range(40, 50))
    assert history.near_batch(known, batch.limit(0)).count() == 0


def test_import_is_planned_without_running(spark, small):
    started = spark.sparkContext.statusTracker()
    known, batch = fixtures.history(spark, small), fixtures.incoming(spark, small)
    spark.sparkContext.setJobGroup("plan-only", "no job may start")
    history.new_rows(known, batch)
    assert started.getJobIdsForGroup("plan-only") in ([], (), None)
    spark.sparkContext.setJobGroup("rest", "")


def test_copies_of_one_key_collapse_before_the_shuffle(spark):
    hot = spark.range(0, 20_000).select(
        F.lit("loto6").alias("lottery_type"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("draw_no"),
        F.col("id").alias("note"),
    )
    fresh = history.new_rows(keyed(spark, [1]), hot)
    assert fresh.filter("draw_no = 7").count() == 1
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan


def test_import_twice_inserts_once(spark, small, tmp_path):
    path = str(tmp_path / "history")
    wide = project.to_wide(fixtures.history(spark, small).drop("series", "status"))
    history.write_history(wide, path)
    batch = project.to_wide(fixtures.incoming(spark, small).drop("series", "status"))
    first = {r.lottery_type: r for r in history.import_rows(spark, batch, path).collect()}
    again = {r.lottery_type: r for r in history.import_rows(spark, batch, path).collect()}
    for kind in ("loto6", "loto7"):
        assert first[kind].inserted_rows > 0 and again[kind].inserted_rows == 0
        assert again[kind].skipped_rows == again[kind].total_rows
    assert spark.read.parquet(path).count() == fixtures.draws(spark, small).count()


def test_scans_push_filters_and_prune_columns(spark, small, tmp_path):
    path = str(tmp_path / "history")
    history.write_history(fixtures.wide_draws(spark, small).drop("series"), path)
    scan = history.range_scan(spark.read.parquet(path), "loto6", 400, 900, 100)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(draw_no,250)" in plan and "LessThanOrEqual(draw_no,900)" in plan
    assert "PartitionFilters: [isnotnull(lottery_type" in plan
    assert "status" not in plan.split("ReadSchema")[1]
    assert "n7" not in scan.columns and "b2" not in scan.columns
    assert scan.agg(F.min("draw_no"), F.max("draw_no")).first()[:] == (251, 899)


def test_latest_n_is_a_top_k(spark, small):
    newest = history.latest_n(fixtures.draws(spark, small), 5)
    assert [r.draw_no for r in newest.collect()] == [1500, 1499, 1498, 1497, 1496]
    assert "TakeOrderedAndProject" in newest._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        history.latest_n(newest, 0)
    with pytest.raises(ValueError):
        history.date_range_scan(newest, "2001-01-02", "2001-01-01")


def test_audit_rows_have_all_columns_and_trace_in_time_order(spark, tmp_path):
    rows = spark.sql(
        "select 'e1' execution_id, 'import' function_name, 'SUCCESS' status, timestamp'2026-01-02 03:00:00' executed_at "
        "union all select 'e1', 'fetch', 'SUCCESS', timestamp'2026-01-02 02:00:00' "
        "union all select 'e2', 'fetch', 'FAILED', timestamp'2026-01-02 02:00:00'"
    )
    path = str(tmp_path / "audit")
    audit.append_audit(rows, path)
    table = spark.read.parquet(path)
    assert set(audit.AUDIT_COLUMNS) == set(table.columns)
    assert [r.stage for r in audit.trace(table, "e1").collect()] == ["fetch", "import"]
    audit.append_audit(rows.withColumn("executed_at", F.raise_error(F.lit("boom")).cast("timestamp")), path)
    assert spark.read.parquet(path).count() == 3


def scanned_rows(frame):
    """Rows that the scan of a frame gave to the rest of its plan."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        inner = leaf.plan() if leaf.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage")) else leaf
        for scan in [inner] if not hasattr(inner, "collectLeaves") else [inner.collectLeaves().apply(j) for j in range(inner.collectLeaves().size())]:
            metric = scan.metrics().get("numOutputRows")
            if metric.isDefined():
                total += metric.get().value()
    return total


def test_trace_skips_row_groups_by_bloom_filter(spark, tmp_path):
    path = str(tmp_path / "audit")
    for part in range(6):
        rows = spark.range(part * 3000, (part + 1) * 3000).select(
            F.md5(F.col("id").cast("string")).alias("execution_id"), F.lit("import").alias("function_name"),
            F.lit("SUCCESS").alias("status"), F.to_timestamp(F.lit("2030-01-01 00:00:00")).alias("executed_at"),
        )
        audit.append_audit(rows.coalesce(1), path)
    table = spark.read.parquet(path)
    wanted = spark.range(1).select(F.md5(F.lit("7001"))).first()[0]
    found = audit.trace(table, wanted)
    assert found.count() == 1
    # Ids are hashes, so each file spans all of them: only filters tell that five of six files lack this one.
    assert scanned_rows(table.filter(F.col("execution_id") == wanted)) <= 2 * 3000
    assert scanned_rows(table.filter(F.concat("execution_id", F.lit("")) == wanted)) == 18_000
    assert audit.trace(table, wanted, since="2030-01-02").count() == 0
