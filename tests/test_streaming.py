import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from drawlake import fixtures
from drawlake.sources import history
from drawlake.sources.known import index_of, known_numbers, lookup
from drawlake.streaming import dedupe, jobs
from drawlake.streaming.batches import spread


def start(spark, source, known, root):
    schema = spark.read.parquet(source).schema
    stream = jobs.file_stream(spark, source, schema, files_per_batch=1)
    out = {n: f"{root}/{n}" for n in ("table", "outbox", "audit", "checkpoint")}
    jobs.import_stream(stream, known, **out).awaitTermination()
    return out


def test_import_stream_equals_batch_and_continues(spark, small, tmp_path):
    known = fixtures.history(spark, small)
    batch = fixtures.incoming(spark, small).drop("series", "status")
    want = history.new_rows(known, batch)
    source = str(tmp_path / "source")
    early, late = batch.filter("draw_no % 2 = 0 or draw_no is null"), batch.filter("draw_no % 3 = 0")
    early.coalesce(2).write.mode("append").parquet(source)
    out = start(spark, source, known, str(tmp_path))
    # Later files repeat draws of the earlier ones; the restarted stream only sees the new files.
    late.coalesce(1).write.mode("append").parquet(source)
    start(spark, source, known, str(tmp_path))
    got = jobs.imported(spark, out["table"], batch.schema).read()
    reachable = want.filter("draw_no % 2 = 0 or draw_no % 3 = 0")
    assert got.count() == got.select("draw_no").distinct().count() == reachable.count()
    assert spark.read.parquet(out["outbox"]).select("batch_id").distinct().count() == 3
    metrics = spark.read.parquet(out["outbox"]).agg(F.sum("total_rows"), F.sum("inserted_rows")).first()
    assert metrics[:] == (early.count() + late.count(), reachable.count())
    assert spark.read.parquet(out["audit"]).filter("status = 'SUCCESS'").count() == 5


def test_dedupe_stream_sends_each_execution_once(spark, small, tmp_path):
    sent = fixtures.messages(spark, small)
    source = str(tmp_path / "source")
    sent.repartition(3).write.parquet(source)
    stream = jobs.file_stream(spark, source, sent.schema, files_per_batch=1)
    table, letters = str(tmp_path / "t"), str(tmp_path / "l")
    dedupe.dedupe_stream(stream, table=table, dead_letters=letters, checkpoint=str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(table)
    assert got.count() == got.select("execution_id").distinct().count() == 396
    assert spark.read.parquet(letters).select("reason").distinct().collect()[0][0] == "invalid_json"
    other = str(tmp_path / "stateful")
    jobs.dedupe_stateful(stream, table=other, checkpoint=str(tmp_path / "c2")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(other).select("execution_id").collect()) == sorted(
        r[0] for r in got.select("execution_id").collect()
    )
    runs = got.limit(100)
    assert jobs.unsent(got, runs).count() == 296


def test_predict_stream_runs_each_execution_once(spark, small, tmp_path):
    draws = fixtures.draws(spark, small)
    body = lambda e, k, extra="": f'{{"execution_id": "{e}", "lottery_type": "{k}"{extra}}}'.encode()
    source = str(tmp_path / "source")
    out = {n: str(tmp_path / n) for n in ("runs", "outbox", "dead_letters", "audit", "checkpoint")}

    def send(*values):
        spark.createDataFrame([(v,) for v in values], "value binary").coalesce(1).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, spark.read.parquet(source).schema)
        jobs.predict_stream(stream, draws, history_limit=60, count=2, as_of="2026-01-02 03:04:05", **out).awaitTermination()

    send(body("a", "loto6"), body("a", "loto6"), body("b", "loto7", ', "draw_no": 77, "draw_date": "2026-01-01", "notify": false'), b"{")
    send(body("a", "loto6"), body("c", "loto6"))
    runs = {r.execution_id: r for r in spark.read.parquet(out["runs"]).collect()}
    assert set(runs) == {"a", "b", "c"} and spark.read.parquet(out["runs"]).count() == 3
    assert (runs["b"].latest_draw_no, str(runs["b"].draw_date), runs["b"].status) == (77, "2026-01-01", "DRY_RUN")
    assert runs["a"].status == "SUCCESS" and runs["a"].seed != runs["c"].seed
    assert spark.read.parquet(out["outbox"]).filter("message like '%2口目%'").count() == 3
    assert spark.read.parquet(out["dead_letters"]).count() == 1
    audit = spark.read.parquet(out["audit"]).filter("stage = 'generate_notify'")
    assert audit.filter("status = 'SUCCESS'").count() == 3
    assert [r.error_detail for r in audit.filter("status = 'FAILED'").collect()] == ["invalid_json"]


def test_failed_batch_leaves_an_audit_row(spark, tmp_path):
    with pytest.raises(ZeroDivisionError), jobs.audited(spark, "import", str(tmp_path / "b")):
        1 / 0
    row = spark.read.parquet(f"{tmp_path}/b-failed").first()
    assert (row.stage, row.status, row.error_type, row.error_detail) == ("import", "FAILED", "ZeroDivisionError", "division by zero")


def executions(spark, rows):
    """Messages (execution, time) as a transport brings them; a missing execution is no JSON."""
    body = '{"execution_id": "%s", "lottery_type": "loto6", "gcs_uri": "gs://b/o"}'
    values = [((body % e if e else "{").encode(), t) for e, t in rows]
    return spark.createDataFrame(values, "value binary, day string").select("value", F.to_timestamp("day").alias("event_time"))


def run_dedupe(spark, root, batches, **options):
    """One landed file and one micro-batch per list of messages; returns what was sent and the dead letters."""
    sent, source = [], f"{root}/source"
    for batch in batches:
        executions(spark, batch).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, spark.read.parquet(source).schema)
        dedupe.dedupe_stream(
            stream, table=f"{root}/t", dead_letters=f"{root}/l", checkpoint=f"{root}/c", **options
        ).awaitTermination()
    sent = sorted(r.execution_id for r in spark.read.parquet(f"{root}/t").collect())
    return sent, spark.read.parquet(f"{root}/l").count()


# 2030-02-24 begins a stretch of forty days since 1970.
COPIES = [("a", "2030-02-23 23:59:00"), ("a", "2030-02-24 00:01:00"), ("b", "2030-01-20"), ("b", "2030-02-26"), ("c", None), ("c", None), (None, None)]


def test_copies_across_borders_are_sent_once(spark, tmp_path):
    groupings = [[COPIES], [[c] for c in COPIES], [COPIES[::2], COPIES[1::2]], [COPIES[3:], COPIES[:3]]]
    for k, batches in enumerate(groupings):
        assert run_dedupe(spark, tmp_path / str(k), batches) == (["a", "b", "c"], 1), k


def test_late_first_copies_are_sent_and_old_ones_forgotten(spark, tmp_path):
    batches = [[("new", "2030-06-01")], [("late", "2030-01-01")], [("late", "2030-01-02"), ("x", "2030-07-20")], [("y", "2030-07-21")]]
    sent, _ = run_dedupe(spark, tmp_path / "a", batches)
    assert sent == ["late", "new", "x", "y"]
    # Stream time has moved on by more than the retention since "new" came, not since "late" did.
    sent, _ = run_dedupe(spark, tmp_path / "a", [[("late", "2030-01-02"), ("new", "2030-06-01"), ("x", "2030-07-20")]])
    assert sent == ["late", "new", "new", "x", "y"]
    sent, _ = run_dedupe(spark, tmp_path / "a", [[("z", "2030-12-01")], [("late", "2030-01-02")]])
    assert sent == ["late", "late", "new", "new", "x", "y", "z"]


def test_hot_keys_collapse_before_the_state(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dedupe, "HELD_ROWS", 100)
    keys = ["hot"] * 5000 + [f"k{i % 150}" for i in range(600)] + [dedupe.BAD + "1"] * 7
    rows = pa.table({"_key": keys, "_us": [10_000 - i for i in range(len(keys))], "_clock": pa.array([None] * len(keys), pa.int64())})
    out = pa.Table.from_batches(list(dedupe.collapse(iter(rows.to_batches(max_chunksize=400)))))
    got = out["_key"].to_pylist()
    assert got.count("hot") <= 15 and got.count(dedupe.BAD + "1") == 7 and got.count(dedupe.TICK) == 1
    assert {*got} == {*keys, dedupe.TICK} and len(got) < 800
    assert out.filter(pa.compute.equal(out["_key"], dedupe.TICK))["_clock"].to_pylist() == [10_000]
    whole = [r for b in dedupe.collapse(iter(rows.slice(0, 90).to_batches())) for r in b.to_pylist()]
    assert [(r["_key"], r["_us"]) for r in whole][0] == ("hot", 9911)
    assert list(dedupe.collapse(iter([]))) == []


class Bucket:
    """State, timers and stream time of one bucket, as a stream keeps them; counts the calls."""

    def __init__(self, retention):
        self.log, self.timers, self.now, self.calls = [], set(), 0, 0
        self.send = dedupe.SendOnce(retention)
        self.send.init(self)

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(list(self.log))

    def appendValue(self, entry):
        self.put([*self.log, entry])

    def put(self, entries):
        self.calls, self.log = self.calls + 1, list(entries)

    def clear(self):
        self.put([])

    def registerTimer(self, time):
        self.calls += 1
        self.timers.add(time)

    def getCurrentWatermarkInMs(self):
        return self.now

    def batch(self, rows):
        """Keys that go out for (key, milliseconds) rows."""
        table = pa.table({"_key": [k for k, _ in rows], "_us": pa.array([t and t * 1000 for _, t in rows], pa.int64())})
        blocks = [Row(_rows=None), *(Row(_rows=dedupe.packed(part)) for part in (table[::2], table[1::2]) if part.num_rows)]
        out = [k for r in self.send.handleInputRows((0,), iter(blocks), self) for k in dedupe.unpacked(r["_rows"])["_key"].to_pylist()]
        for time in sorted(t for t in self.timers if t < self.now):
            assert not list(self.send.handleExpiredTimer((0,), self, None))
            self.timers.remove(time)
        self.now = max([self.now, *(t for _, t in rows if t)])
        return out


def test_a_bucket_remembers_as_if_each_execution_were_kept_alone(monkeypatch):
    for length, seed in itertools.product((2, 32), range(20)):
        monkeypatch.setattr(dedupe, "LOG_LENGTH", length)
        rand, bucket, kept, letter = random.Random(seed), Bucket(40), {}, dedupe.BAD + "1"
        for step in range(120):
            near = bucket.now + rand.choice([-60, 0, 0, 5, 30])
            rows = [(f"é{rand.randrange(15)}", rand.choice([None, max(1, near + rand.randrange(-9, 9))])) for _ in range(rand.choice([0, 1, 4]))]
            now, want = bucket.now, []
            for key, time in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0)):
                if key not in kept:
                    kept[key] = (now if time is None else time, now + 1, None)
                    want.append(key)
            for key, (time, first, until) in list(kept.items()):
                if until is None and first < now:
                    kept[key] = (time, first, max(time, now) + 40)
                elif until is not None and until < now:
                    del kept[key]
            assert sorted(bucket.batch([*rows, (letter, 1), (letter, 1)])) == sorted([*want, letter, letter]), (length, seed, step)
        assert len(bucket.log) <= length + 1
        # Nothing stays once all is forgotten.
        for _ in range(3):
            bucket.now += 1000
            bucket.batch([])
        assert not bucket.log and not bucket.timers


def test_state_calls_do_not_grow_with_the_executions():
    calls = []
    for count in (1, 5000):
        bucket = Bucket(10**9)
        for batch in range(3):
            assert len(bucket.batch([(f"{batch}-{i}", 10 + batch) for i in range(count)])) == count
            assert not bucket.batch([(f"{batch}-{i}", 10 + batch) for i in range(count)])
        calls.append(bucket.calls)
    assert calls[0] == calls[1] < 40


def test_rows_are_packed_by_bucket_and_unpacked_whole(monkeypatch):
    monkeypatch.setattr(dedupe, "PACKED_ROWS", 30)
    count, clock = 100, pa.timestamp("us", tz="UTC")
    keys = [dedupe.TICK if i % 25 == 0 else dedupe.BAD + str(i) if i % 10 == 0 else f"k{i}" for i in range(count)]
    rows = pa.table({
        "_key": keys, "_us": pa.array([None if i % 3 else i for i in range(count)], pa.int64()), "big": pa.array([2**62 + i for i in range(count)]),
        "_clock": pa.array([i if k == dedupe.TICK else None for i, k in enumerate(keys)], pa.int64()).cast(clock),
        "_bucket": pa.array([None if k == dedupe.TICK else i % 7 for i, k in enumerate(keys)], pa.int32()),
    })
    out = list(dedupe.pack(iter(rows.to_batches(max_chunksize=20))))
    blocks = pa.Table.from_batches(out)
    assert blocks["_bucket"].to_pylist()[-1] == -1 and blocks["_clock"].cast(pa.int64()).to_pylist()[-1] == 75
    assert blocks["_clock"].null_count == blocks.num_rows - 1 and blocks.num_rows <= 4 * 7 + 1
    whole = pa.Table.from_batches([b for b in dedupe.unpack(iter(o.filter(pa.compute.is_valid(o["_rows"])) for o in out))])
    want = rows.filter(pa.compute.not_equal(rows["_key"], dedupe.TICK)).drop_columns(["_clock", "_bucket"])
    assert whole.sort_by("big").equals(want.sort_by("big"))
    assert list(dedupe.pack(iter([]))) == []


def test_state_has_no_more_stores_than_cores_can_use(spark):
    before = {name: spark.conf.get(name, None) for name in (dedupe.PARTITIONS, dedupe.PROVIDER, dedupe.CHANGELOG)}
    most = max(2 * spark.sparkContext.defaultParallelism, dedupe.LEAST_STORES)
    try:
        for width, stores in ((3, 3), (5000, most)):
            spark.conf.set(dedupe.PARTITIONS, width)
            with dedupe.keyed_state(spark):
                assert spark.conf.get(dedupe.PARTITIONS) == str(stores)
            assert spark.conf.get(dedupe.PARTITIONS) == str(width)
    finally:
        spark.conf.set(dedupe.PARTITIONS, before[dedupe.PARTITIONS])
    assert before == {name: spark.conf.get(name, None) for name in before}


def test_all_landed_files_make_one_batch_unless_they_are_counted(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(40).repartition(4).write.parquet(source)
    for files, want in ((None, 1), (1, 4)):
        batches = []
        stream = jobs.file_stream(spark, source, spark.range(1).schema, files_per_batch=files)
        query = stream.writeStream.foreachBatch(lambda b, i: batches.append(b.count())).trigger(availableNow=True)
        query.option("checkpointLocation", str(tmp_path / f"c{files}")).start().awaitTermination()
        assert len(batches) == want and sum(batches) == 40


def test_a_batch_of_one_file_is_decoded_by_many_tasks(spark, small):
    one = fixtures.messages(spark, small).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert sorted(map(str, spread(one).collect())) == sorted(map(str, one.collect()))


def test_a_batch_of_one_file_is_imported_by_many_tasks(spark, small, tmp_path, monkeypatch):
    widths, metrics = [], jobs.import_metrics

    def seen(rows, inserted):
        widths.append(rows.rdd.getNumPartitions())
        return metrics(rows, inserted)

    monkeypatch.setattr(jobs, "import_metrics", seen)
    source = str(tmp_path / "source")
    batch = fixtures.incoming(spark, small).drop("series", "status")
    batch.unionByName(batch).coalesce(1).write.parquet(source)
    known = fixtures.history(spark, small)
    out = start(spark, source, known, str(tmp_path))
    assert widths == [int(spark.conf.get("spark.sql.shuffle.partitions"))] and widths[0] > 1
    got = jobs.imported(spark, out["table"], batch.schema).read()
    assert sorted(map(str, got.collect())) == sorted(map(str, history.new_rows(known, batch).select(got.columns).collect()))


def test_known_rows_go_before_copies_collapse(spark, tmp_path, monkeypatch):
    collapsed, once = [], history.one_per_key
    monkeypatch.setattr(history, "one_per_key", lambda rows, keys: collapsed.append(rows.count()) or once(rows, keys))
    schema = "lottery_type string, draw_no bigint, source_url string"
    index = known_numbers(spark, str(tmp_path / "i"))
    index.write(index_of(spark.createDataFrame([("loto6", n, "") for n in range(50)], schema)), 0)
    rows = [("loto6", n, u) for n in range(45, 53) for u in "ab"] + [("loto7", 1, "a"), (None, 2, "a"), (None, 2, "b"), ("loto6", None, "a")]
    batch = spark.createDataFrame(rows, schema)
    found = lookup(index, batch)
    want = [("loto6", 50, "b"), ("loto6", 51, "b"), ("loto6", 52, "b"), ("loto7", 1, "a"), (None, 2, "b")]
    assert sorted(map(tuple, history.indexed_new_rows(found, batch).collect()), key=str) == sorted(want, key=str)
    assert collapsed == [9]
    assert history.indexed_new_rows(found, batch, dedupe=False).count() == 9
