"""Structured Streaming jobs: import, duplicate suppression, stage outbox, audit.

All sinks are idempotent per micro-batch: a batch writes its own folder with
overwrite, so a batch repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from drawlake.operators.rank import one_per_key
from drawlake.operators.validate import parse_date
from drawlake.plans.predict import prediction_runs, run_digest
from drawlake.sources.audit import append_audit, audit_rows
from drawlake.sources.history import batch_latest_row, import_metrics, indexed_new_rows
from drawlake.sources.known import index_of, known_numbers, lookup
from drawlake.sources.messages import split_messages
from drawlake.sources.segments import SegmentedTable
from drawlake.streaming.batches import batch_folder, spread


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, files_per_batch: int | None = 1000
) -> DataFrame:
    """Landed Parquet files as a stream; other transports only replace this source.

    Without ``files_per_batch`` all files that are there make one batch.
    """
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def imported(spark: SparkSession, table: str, schema: T.StructType) -> SegmentedTable:
    """The table that ``import_stream`` appends to; ``read`` gives its rows."""
    return SegmentedTable(spark, table, schema)


# What the outbox of the import stage holds besides its metrics: the message and the batch it comes from.
OUTBOX = T.StructType([T.StructField("value", T.BinaryType()), T.StructField("batch_id", T.LongType())])


def import_stream(
    stream: DataFrame, history: DataFrame, *, table: str, outbox: str, audit: str, checkpoint: str
) -> StreamingQuery:
    """Append draws not seen in the history or in earlier batches.

    Known draw numbers are a bitmap index below the table. The numbers of ``history``
    go into it when it is first used; later, a batch reads only the index rows of the
    numbers that it brings, and no rows of earlier batches. Each batch writes its new
    rows, one message per pool for the next stage, and one audit row per pool.
    """
    spark = stream.sparkSession
    target = imported(spark, table, stream.schema)
    index = known_numbers(spark, f"{table}/known")
    # The index numbers its parts from the history, 0, on.
    if index.merged_upto() < 0 and 0 not in index.open_batches(-1):
        index.write(index_of(history), 0)

    def import_batch(batch: DataFrame, batch_id: int) -> None:
        # A batch that a segment covers was done long ago.
        if batch_id <= target.merged_upto():
            return
        with audited(spark, "import", batch_folder(audit, batch_id)):
            # Every pass over the batch is as wide as the cluster, however few files landed.
            batch = spread(batch).persist()
            try:
                run_batch(batch, batch_id)
            finally:
                batch.unpersist()

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        target.merge(before=batch_id)
        index.merge(before=batch_id + 1)
        fresh = indexed_new_rows(lookup(index, batch, before=batch_id + 1), batch).select(*batch.columns)
        inserted = target.write(fresh, batch_id)
        index.write(index_of(inserted), batch_id + 1)
        done = (
            import_metrics(batch, inserted)
            .join(batch_latest_row(batch.select("lottery_type", "draw_no", "draw_date")), "lottery_type")
            .withColumn("execution_id", F.md5(F.concat_ws("|", F.lit(f"import-{batch_id}"), "lottery_type")))
        )
        message = F.to_json(F.struct("execution_id", "lottery_type", "draw_no", F.col("draw_date").cast("string")))
        done.withColumn("value", message.cast("binary")).write.mode("overwrite").parquet(batch_folder(outbox, batch_id))
        note = F.format_string(
            "draw_no=%d total_rows=%d inserted_rows=%d skipped_rows=%d",
            "draw_no", "total_rows", "inserted_rows", "skipped_rows",
        )
        rows = spark.read.parquet(batch_folder(outbox, batch_id)).select(
            "execution_id", F.lit("import").alias("function_name"), "lottery_type",
            F.lit("SUCCESS").alias("status"), note.alias("message"), "draw_no",
            F.current_timestamp().alias("executed_at"),
        )
        _write_audit(rows, batch_folder(audit, batch_id))

    return (
        stream.writeStream.foreachBatch(import_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


@contextmanager
def audited(spark: SparkSession, stage: str, folder: str) -> Iterator[None]:
    """A batch that fails leaves a FAILED audit row with error type and text, then fails as before."""
    try:
        yield
    except Exception as error:
        row = [(stage, "FAILED", type(error).__name__, str(error)[:1000])]
        rows = spark.createDataFrame(row, "function_name string, status string, error_type string, error_detail string")
        _write_audit(rows.withColumn("executed_at", F.current_timestamp()), f"{folder}-failed")
        raise


def refused(bad: DataFrame, stage: str) -> DataFrame:
    """FAILED audit rows of messages that can't be used."""
    return bad.select(
        "execution_id", F.lit(stage).alias("function_name"), "lottery_type", F.lit("FAILED").alias("status"),
        F.lit("dead_letter").alias("error_type"), F.col("reason").alias("error_detail"), "draw_no",
        F.current_timestamp().alias("executed_at"),
    )


def _write_audit(rows: DataFrame, folder: str) -> None:
    """Audit rows of one batch; like ``append_audit`` it never breaks the batch."""
    try:
        audit_rows(rows).write.mode("overwrite").parquet(folder)
    except Exception:
        append_audit(rows, f"{folder}-retry")


def dedupe_stateful(
    stream: DataFrame, *, table: str, checkpoint: str, delay: str = "40 days"
) -> StreamingQuery:
    """The built-in operator, for evenly spread keys and transports in order.

    ``delay`` bounds the state and must exceed the disorder of the transport: later
    messages are dropped. All copies of one execution meet in one task. Neither
    holds for ``streaming.dedupe``.
    """
    good, _ = split_messages(spread(stream))
    unique = good.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["execution_id"])
    return (
        unique.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def unsent(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """Messages whose execution has no run yet: the second guard against double delivery,
    effective beyond the state retention of the stream."""
    once = one_per_key(messages, ["execution_id"])
    return once.join(runs.select("execution_id").distinct(), "execution_id", "left_anti")


def predict_stream(
    stream: DataFrame,
    draws: DataFrame,
    *,
    runs: str,
    outbox: str,
    dead_letters: str,
    audit: str,
    checkpoint: str,
    history_limit: int = 100,
    count: int = 5,
    strategy: str = "mixed",
    as_of: str,
) -> StreamingQuery:
    """Prediction stage: one tuned run per requested pool and execution.

    ``stream`` has ``value``, also the outbox of the import stage. Messages name a pool.
    Executions that already have a run are skipped. Runs, digest texts and audit rows
    of a batch are written before anything is sent, so a repeated batch cannot deliver
    twice.
    """
    spark = stream.sparkSession

    def predict_batch(batch: DataFrame, batch_id: int) -> None:
        with audited(spark, "generate_notify", batch_folder(audit, batch_id)):
            batch = batch.persist()
            try:
                run_batch(batch, batch_id)
            finally:
                batch.unpersist()

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_messages(batch, need_uri=False)
        bad.write.mode("overwrite").parquet(batch_folder(dead_letters, batch_id))
        requests = one_per_key(
            good.select("execution_id", "lottery_type", "draw_no", "draw_date", "notify"), ["execution_id"]
        ).withColumn("draw_date", parse_date(F.col("draw_date")))
        if batch_id > 0:
            done = spark.read.parquet(runs).filter(F.col("batch_id") < batch_id)
            requests = requests.join(done.select("execution_id"), "execution_id", "left_anti")
        folder = batch_folder(runs, batch_id)
        # Only requested pools are tuned; usable messages name one of two.
        asked = draws.join(F.broadcast(requests.select("lottery_type").distinct()), "lottery_type", "left_semi")
        prediction_runs(
            asked, series_cols=["lottery_type"], history_limit=history_limit, count=count,
            strategy=strategy, as_of=as_of, requests=requests,
        ).write.mode("overwrite").parquet(folder)
        finished = spark.read.parquet(folder)
        run_digest(finished).write.mode("overwrite").parquet(batch_folder(outbox, batch_id))
        failed = F.col("status") == "FAILED"
        rows = finished.select(
            "execution_id", F.lit("generate_notify").alias("function_name"), "lottery_type",
            F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
            F.when(failed, "run_failed").alias("error_type"), F.col("error").alias("error_detail"),
            F.col("latest_draw_no").alias("draw_no"), F.current_timestamp().alias("executed_at"),
        )
        _write_audit(rows.unionByName(refused(bad, "generate_notify")), batch_folder(audit, batch_id))

    return (
        stream.writeStream.foreachBatch(predict_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
