"""Segmented tables and the bitmap index against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from drawlake.sources import history, known, segments
from drawlake.streaming import jobs

SCHEMA = "lottery_type string, draw_no bigint"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def keys(frame):
    return sorted(((r.lottery_type, r.draw_no) for r in frame.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MERGE_EVERY", 3)
    return segments.SegmentedTable(spark, str(tmp_path / "t"), rows_of(spark, [("", 0)]).schema)


def folders(table):
    return sorted(table._names("open")), sorted(table._names("merged"))


def test_batches_become_segments_and_folders_stay_few(spark, table):
    want = []
    assert table.read().count() == 0
    for batch in range(14):
        table.merge(before=batch)
        own = [("loto6", 10 * batch + k) for k in range(2)] + ([("loto7", batch)] if batch % 2 else [])
        table.write(rows_of(spark, own), batch)
        want += own
        assert keys(table.read()) == sorted(want, key=str) and sum(map(len, folders(table))) <= 11
        assert keys(table.read(before=batch)) == sorted(set(want) - set(own), key=str)
    made = table.segments()
    assert {(s.first, s.last, s.level) for s in made} == {(0, 8, 1), (9, 11, 0)}
    assert made[0].ranges == {"loto6": [0, 81], "loto7": [1, 7]}
    # Segments that cannot hold a key are not read; open batches always are.
    files = table.read(before=12, wanted={"loto6": (95, 95)}).inputFiles()
    assert files and all("/merged/0-" in f for f in files)
    assert table.read(before=12, wanted={"mini": (1, 2)}).inputFiles() == []


def test_repeated_batches_replace_themselves(spark, table):
    for batch in range(3):
        table.write(rows_of(spark, [("loto6", batch)]), batch)
    table.write(rows_of(spark, [("loto6", 77)]), 2)
    assert keys(table.read()) == [("loto6", 0), ("loto6", 1), ("loto6", 77)]
    table.merge(before=3)
    # Merged batches are final: a stream that starts over changes nothing.
    assert table.write(rows_of(spark, [("loto6", 5)]), 1).count() == 0
    assert keys(table.read()) == [("loto6", 0), ("loto6", 1), ("loto6", 77)] and table.merged_upto() == 2


def test_failed_merges_leave_what_was_there(spark, table, monkeypatch):
    for batch in range(3):
        table.write(rows_of(spark, [("loto6", batch), (None, batch)]), batch)
    before = keys(table.read())
    monkeypatch.setattr(table, "_commit", lambda s: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.merge(before=3)
    assert keys(table.read()) == before and table.segments() == []
    monkeypatch.undo()
    monkeypatch.setattr(segments, "MERGE_EVERY", 3)
    table.merge(before=3)
    assert keys(table.read()) == before and table.segments()[0].ranges == {}
    # A half-written batch has no success mark and is not read.
    table.write(rows_of(spark, [("loto6", 9)]), 3)
    table._files.delete(table._path(f"{table._open(3)}/_SUCCESS"), False)
    assert keys(table.read()) == before


def test_index_equals_a_set(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MERGE_EVERY", 2)
    pick = random.Random(4)
    index = known.known_numbers(spark, str(tmp_path / "i"))
    numbers = [0, -1, -40_000, 1, 32_767, 32_768, 32_769, 2**40, *[pick.randrange(10**6) for _ in range(300)]]
    have = [(pick.choice(["loto6", "loto7"]), n) for n in numbers]
    for batch in range(5):
        index.merge(before=batch)
        index.write(known.index_of(rows_of(spark, have[batch::5] + have[batch:40:5] + [("loto6", None), (None, 3)])), batch)
    asked = [(k, n + d) for n in numbers for k in ("loto6", "loto7") for d in (0, 1)] + [("loto6", None), (None, 3), ("mini", 1)]
    batch = rows_of(spark, asked)
    for most in (4096, 1):
        monkeypatch.setattr(known, "MOST_LISTED", most)
        got = known.mark_known(batch, known.lookup(index, batch)).collect()
        assert len(got) == len(asked)
        assert all(r.known == ((r.lottery_type, r.draw_no) in set(have) and r.lottery_type is not None) for r in got)
    assert keys(history.indexed_keys(known.lookup(index, batch), batch)) == sorted(set(have) & set(asked), key=str)
    assert keys(history.indexed_new_rows(known.lookup(index, batch), batch)) == sorted(
        {a for a in asked if a[1] is not None} - set(have), key=str
    )
    assert known.lookup(index, batch.limit(0)).count() == 0


def test_an_outlier_reads_its_own_bucket_only(spark, tmp_path):
    index = known.known_numbers(spark, str(tmp_path / "i"))
    old = spark.range(1, 2_000_000, 50).select(F.lit("loto6").alias("lottery_type"), F.col("id").alias("draw_no"))
    index.write(known.index_of(old), 0)
    batch = rows_of(spark, [("loto6", 51), ("loto6", 1_999_951), ("loto6", 10**13)])
    found = known.lookup(index, batch)
    assert sorted(r.bucket for r in found.collect()) == [1, 62]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(bucket" in plan
    near = history.near_batch(old, batch)
    assert near.count() < 2000 and history.existing_keys(near, batch).count() == 2


def test_spans_join_over_the_smallest_gaps():
    far = 10**6
    spans = [(k * far, k * far + 10) for k in (0, 1, 3, 10, 11)]
    assert history.merged_spans(spans, 9) == spans
    assert history.merged_spans(spans, 2) == [(0, 3 * far + 10), (10 * far, 11 * far + 10)]
    assert history.merged_spans([(0, 5), (32_768, 40_000)], 9) == [(0, 40_000)]
    assert len(history.merged_spans([(k * far, k * far) for k in range(500)], 64)) == 64


def test_import_stream_over_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "MERGE_EVERY", 3)
    pick = random.Random(7)
    out = {n: str(tmp_path / n) for n in ("table", "outbox", "audit", "checkpoint")}
    schema = "lottery_type string, draw_no bigint, draw_date date"
    old = spark.createDataFrame([("loto6", k, None) for k in range(30)], schema)
    seen = set()
    for k in range(9):
        numbers = [pick.randrange(80) for _ in range(12)] + [10**10 + pick.randrange(3)]
        seen |= {n for n in numbers if n >= 30}
        spark.createDataFrame([("loto6", n, None) for n in numbers], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "source"))
        stream = jobs.file_stream(spark, str(tmp_path / "source"), old.schema)
        jobs.import_stream(stream, old, **out).awaitTermination()
        table = jobs.imported(spark, out["table"], old.schema)
        assert sorted(r.draw_no for r in table.read().collect()) == sorted(seen)
    assert table.merged_upto() >= 5 and len(folders(table)[0]) <= 6
    messages = [r[0] for r in spark.read.parquet(out["outbox"]).select(F.col("value").cast("string")).collect()]
    assert len(messages) == 9 and all('"lottery_type":"loto6"' in m for m in messages)
