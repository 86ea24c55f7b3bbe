"""Duplicate suppression with keyed stream state: one message per execution, without borders.

1. Copies of an execution collapse to the earliest inside each task, so a hot key
   reaches the state as one row per task.
2. Executions are dealt into buckets by a hash of their id. A bucket's rows of a batch come
   to the state as a few packed blocks, and its sent executions are a log of blocks, so a
   batch costs a few state calls per bucket and not per execution.
3. The log remembers each execution that was sent. Timers of stream time wake the bucket,
   which forgets an execution ``retention`` after the message's own time or that of the
   stream once the message's batch is through, whichever is later. This bounds the state.

Stream time moves with one tick row per task that carries the largest event time.
Messages themselves carry no clock, so none is ever late and dropped: a first copy
is sent however old it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from drawlake.operators.pin import pin
from drawlake.sources.messages import check_messages
from drawlake.streaming.batches import batch_folder, spread

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"
# A query that starts before all executors are there gets so many stores.
LEAST_STORES = 32
# Keys of rows that are no messages to send; no execution id begins with a zero character.
TICK, BAD = "\x00tick", "\x00bad"
# Dead letters are spread over so many keys.
BAD_KEYS = 997
# Rows that a task holds while it collapses copies.
HELD_ROWS = 50_000
# Executions are dealt into so many buckets; a stream's checkpoint is bound to the number.
BUCKETS = 1024
# Rows and bytes that a task holds while it packs them by bucket.
PACKED_ROWS, PACKED_BYTES = 200_000, 64 << 20
# A bucket's log that is this long is written anew, without what is forgotten.
LOG_LENGTH = 32
# What the state gets: packed rows of a bucket, or a tick.
PACKED = "_bucket int, _clock timestamp, _rows binary"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State of arbitrary operators needs the store that keeps it on local disk; set while a query starts.

    A batch saves its changes alone. Each store costs every batch a task and a commit, so there are no
    more than two per core, or ``LEAST_STORES``; a checkpoint keeps the number with which it began.
    """
    cores = spark.sparkContext.defaultParallelism
    stores = min(int(spark.conf.get(PARTITIONS)), max(2 * cores, LEAST_STORES))
    settings = {PROVIDER: ROCKS, CHANGELOG: "true", PARTITIONS: str(stores)}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _first_copies(rows: pa.Table) -> pa.Table:
    """The earliest row of each execution, other columns breaking ties; all rows without a key of their own."""
    order = ["_key", "_us", *[f.name for f in rows.schema if f.name not in ("_key", "_us") and not pa.types.is_nested(f.type)]]
    rows = rows.sort_by([(name, "ascending") for name in order])
    key = rows["_key"].combine_chunks()
    fresh = pc.or_(pc.starts_with(key[1:], "\x00"), pc.not_equal(key[1:], key[:-1]))
    return rows.filter(pa.concat_arrays([pa.array([True] * min(1, len(key))), fresh.cast(pa.bool_())]))


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task without the copies it can see, and its tick."""
    held, latest, schema = None, None, None
    for batch in batches:
        schema = batch.schema
        newest = pc.max(batch.column("_us")).as_py()
        latest = newest if latest is None else max(latest, newest or latest)
        rows = pa.Table.from_batches([batch])
        held = _first_copies(rows if held is None else pa.concat_tables([held, rows]))
        if held.num_rows > HELD_ROWS:
            yield from held.to_batches()
            held = None
    if held is not None:
        yield from held.to_batches()
    if latest is not None:
        tick = {"_key": TICK, "_clock": latest}
        columns = [
            pa.array([tick.get(f.name)], pa.int64()).cast(f.type) if f.name == "_clock" else pa.array([tick.get(f.name)], f.type)
            for f in schema
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def packed(rows: pa.Table) -> bytes:
    """Rows as one value, which ``unpacked`` reads."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _by_bucket(rows: pa.Table, clock: pa.DataType) -> pa.RecordBatch:
    rows = rows.take(np.argsort(rows["_bucket"].to_numpy(), kind="stable")).combine_chunks()
    bucket = rows["_bucket"].to_numpy()
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    kept = rows.drop_columns(["_bucket", "_clock"])
    blocks = [packed(kept.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True)]
    columns = [pa.array(bucket[starts], pa.int32()), pa.nulls(len(blocks), clock), pa.array(blocks, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["_bucket", "_clock", "_rows"])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per bucket with its packed rows, or a few where a task has many; the task's ticks become one."""
    held, size, latest, clock = [], [0, 0], None, None
    for batch in batches:
        clock = batch.schema.field("_clock").type
        newest = pc.max(batch.column("_clock").cast(pa.int64())).as_py()
        latest = max((time for time in (latest, newest) if time is not None), default=None)
        rows = batch.filter(pc.not_equal(batch.column("_key"), TICK))
        held, size = [*held, rows], [size[0] + rows.num_rows, size[1] + rows.nbytes]
        if size[0] > PACKED_ROWS or size[1] > PACKED_BYTES:
            yield _by_bucket(pa.Table.from_batches(held), clock)
            held, size = [], [0, 0]
    if size[0]:
        yield _by_bucket(pa.Table.from_batches(held), clock)
    if latest is not None:
        columns = [pa.array([-1], pa.int32()), pa.array([latest], pa.int64()).cast(clock), pa.array([None], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["_bucket", "_clock", "_rows"])


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("_rows"):
            yield from unpacked(block.as_py()).to_batches()


class Sent(NamedTuple):
    """Executions that were sent: their times in milliseconds, and their ids as byte lengths and bytes."""

    ms: np.ndarray
    size: np.ndarray
    text: bytes

    @classmethod
    def of(cls, ids: pa.ChunkedArray, ms: np.ndarray) -> Sent:
        return cls(ms.astype("int64"), pc.binary_length(ids).to_numpy().astype("int32"), b"".join(ids.cast(pa.binary()).to_pylist()))

    @classmethod
    def read(cls, block: bytes) -> Sent:
        count, at = int.from_bytes(block[:8], "little"), 8
        ms = np.frombuffer(block, "<i8", count, at)
        size = np.frombuffer(block, "<i4", count, at + ms.nbytes)
        return cls(ms, size, block[at + ms.nbytes + size.nbytes :])

    @classmethod
    def together(cls, parts: list[Sent]) -> Sent:
        return cls(np.concatenate([p.ms for p in parts]), np.concatenate([p.size for p in parts]), b"".join(p.text for p in parts))

    def block(self) -> bytes:
        return len(self.ms).to_bytes(8, "little") + self.ms.astype("<i8").tobytes() + self.size.astype("<i4").tobytes() + self.text

    def ids(self) -> pa.Array:
        ends = np.r_[0, np.cumsum(self.size, dtype="int64")]
        return pa.Array.from_buffers(pa.large_binary(), len(self.size), [None, pa.py_buffer(ends), pa.py_buffer(self.text)])

    def kept(self, keep: np.ndarray) -> Sent:
        return self if keep.all() else Sent(self.ms[keep], self.size[keep], b"".join(self.ids().filter(pa.array(keep)).to_pylist()))


class SendOnce(StatefulProcessor):
    """Lets the first message of each execution pass and remembers it for ``retention_ms`` of stream time.

    A batch may move the stream's time by months, and only the next batch can see how far. So a
    bucket wakes there first, which settles when its new executions are forgotten, and then
    whenever one is to be forgotten. Its log holds, in the order in which they came:

    * ``(first, executions)``: sent ones with their own times. They wait for the stream to pass ``first``.
    * ``(time, null)``: the stream's time when the bucket woke.
    * ``(null, executions)``: sent ones with the times after which they are forgotten.
    """

    def __init__(self, retention_ms: int) -> None:
        self.retention_ms = retention_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "time bigint, executions binary")

    def _read(self, *now: int) -> tuple[int, list[tuple[int | None, Sent]]]:
        """Length of the log, and what the bucket remembers: executions by the time for which they wait, null for settled ones.

        ``now``: the stream's time, where the bucket wakes. Timers fire when the stream has passed them.
        """
        log = list(self.log.get())
        woken, found = [*(time for time, block in log if block is None), *now], []
        for first, sent in ((time, Sent.read(block)) for time, block in log if block is not None):
            passed = None if first is None else next((time for time in woken if time > first), None)
            if passed is not None:
                first, sent = None, sent._replace(ms=np.maximum(sent.ms, passed) + self.retention_ms)
            if first is None and woken:
                sent = sent.kept(sent.ms >= woken[-1])
            if len(sent.ms):
                found.append((first, sent))
        return len(log), found

    def _note(self, length: int, found: list[tuple[int | None, Sent]], entry: tuple) -> None:
        """Adds an entry, which ``found`` includes, to a log of ``length`` entries."""
        if not found:
            self.log.clear()
        elif length < LOG_LENGTH:
            self.log.appendValue(entry)
        else:
            by_first = {first: [s for f, s in found if f == first] for first, _ in found}
            self.log.put([(first, Sent.together(parts).block()) for first, parts in by_first.items()])

    def handleInputRows(self, key, rows, timerValues):
        # A tick has done its work.
        blocks = [unpacked(r["_rows"]) for r in rows if r["_rows"] is not None]
        if not blocks:
            return
        fresh = _first_copies(pa.concat_tables(blocks))
        length, found = self._read()
        # Rows that are no messages pass by the state.
        letter = pc.starts_with(fresh["_key"], "\x00")
        if found:
            known = Sent.together([sent for _, sent in found]).ids()
            new = pc.or_(letter, pc.invert(pc.is_in(fresh["_key"].cast(pa.large_binary()), value_set=known)))
            fresh, letter = fresh.filter(new), letter.filter(new)
        sent = fresh.select(["_key", "_us"]).filter(pc.invert(letter))
        if sent.num_rows:
            now = timerValues.getCurrentWatermarkInMs()
            us = sent["_us"]
            ms = np.where(us.is_null().to_numpy(), now, us.fill_null(0).to_numpy() // 1000)
            added = (now + 1, Sent.of(sent["_key"], ms))
            self._note(length, [*found, added], (now + 1, added[1].block()))
            self.handle.registerTimer(now + 1)
        if fresh.num_rows:
            yield Row(_rows=packed(fresh))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        length, found = self._read(now)
        self._note(length, found, (now, None))
        settled = [sent.ms.min() for first, sent in found if first is None]
        if settled:
            self.handle.registerTimer(int(min(settled)))
        return iter(())


def once_per_execution(messages: DataFrame, *, retention_days: int = 40, **options: object) -> DataFrame:
    """Streaming rows to send, one per execution, and dead letters, with a ``reason``.

    ``messages`` has ``value`` and ``event_time``. Two copies whose times are within the
    retention are sent once, whatever files and batches they come in; messages without a
    time count from the stream's time. A copy that comes when the stream has moved on by
    more than the retention is sent again and left to ``unsent``.
    """
    checked = check_messages(spread(messages), **options)
    bad = F.concat(F.lit(BAD), F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(BAD_KEYS)).cast("string"))
    keyed = pin(
        checked,
        _key=F.when(F.col("reason").isNull(), F.col("execution_id")).otherwise(bad),
        _us=F.unix_micros("event_time"),
        _clock=F.lit(None).cast("timestamp"),
    ).drop("event_time")
    dealt = keyed.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int"))
    # A tick row has nothing but its key and clock.
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in dealt.schema])
    # Blocks are as large as a bucket's rows allow, so rows of a bucket meet before they are packed.
    met = dealt.mapInArrow(collapse, schema).repartition("_bucket")
    ticking = met.mapInArrow(pack, PACKED).withWatermark("_clock", "0 seconds")
    blocks = ticking.groupBy("_bucket").transformWithState(
        SendOnce(retention_days * 86_400_000), "_rows binary", outputMode="Append", timeMode="EventTime"
    )
    kept = T.StructType([f for f in schema if f.name not in ("_bucket", "_clock")])
    sent = blocks.mapInArrow(unpack, kept)
    return sent.withColumn("event_time", F.timestamp_micros("_us")).drop("_key", "_us")


def dedupe_stream(
    stream: DataFrame, *, table: str, dead_letters: str, checkpoint: str, retention_days: int = 40
) -> StreamingQuery:
    """Writes one message per execution to ``table`` and undecodable ones to ``dead_letters``, a folder per batch.

    A repeated batch finds the state of its first run and replaces its own rows.
    """
    spark = stream.sparkSession
    rows = once_per_execution(stream, retention_days=retention_days)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good = batch.filter(F.col("reason").isNull()).drop("reason")
            good.write.mode("overwrite").parquet(batch_folder(table, batch_id))
            batch.filter(F.col("reason").isNotNull()).write.mode("overwrite").parquet(batch_folder(dead_letters, batch_id))
        finally:
            batch.unpersist()

    with keyed_state(spark):
        return (
            rows.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
