import pytest
from pyspark.sql import functions as F

from drawlake import fixtures
from drawlake.operators import project, validate
from drawlake.sources import files


def draw_rows(spark):
    """Invented draws: runs of numbers from a start; one without bonus and url."""
    made = lambda start, count: list(range(start, start + count))
    return spark.createDataFrame(
        [
            ("loto6", 71, "2030-01-03", made(11, 6), [40], "https://example.com/a"),
            ("loto7", 72, "2030-01-04", made(21, 7), [1, 2], 'https://example.com/"q",b\nsecond line'),
            ("loto6", 73, "2030-01-07", made(31, 6), [], ""),
        ],
        "lottery_type string, draw_no bigint, draw_date string, main_numbers array<int>, bonus_numbers array<int>, source_url string",
    )


def test_csv_keeps_both_pools_and_missing_values(spark, tmp_path):
    path = str(tmp_path / "csv")
    files.write_canonical_csv(draw_rows(spark).coalesce(1), path)
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.splitlines()[0] == ",".join(files.CSV_COLUMNS)
    assert "loto6,71,2030-01-03,11,12,13,14,15,16,\\N,40,\\N,https://example.com/a" in text
    back = {r.draw_no: r for r in files.read_canonical_csv(spark, path).collect()}
    assert len(back) == 3
    assert back[71].n7 is None and back[71].b2 is None and back[71].n6 == 16
    assert back[72].n7 == 27 and back[72].source_url == 'https://example.com/"q",b\nsecond line'
    assert back[73].b1 is None and back[73].source_url is None


def test_csv_is_read_by_column_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "source_url,draw_no,lottery_type,draw_date,n1,n2,n3,n4,n5,n6,n7,b1,b2\nu,7,loto6,2026-01-02,1,2,3,4,5,6,\\N,9,\n"
    )
    row = files.read_canonical_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row.draw_no, row.lottery_type, row.n1, row.b1, row.b2, row.source_url) == (7, "loto6", 1, 9, None, "u")


def test_csv_without_a_column_or_with_bad_integers_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lottery_type,draw_no\nloto6,1\n")
    with pytest.raises(ValueError, match="missing CSV columns"):
        files.read_canonical_csv(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text(",".join(files.CSV_COLUMNS) + "\nloto6,x,2026-01-02,1,2,3,4,5,6,,9,,u\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_canonical_csv(spark, str(tmp_path / "b.csv")).collect()


def test_older_exports_map_to_the_canonical_columns(spark, tmp_path):
    six_names = [*(f"number{i}" for i in range(1, 7)), "bonus1"]
    (tmp_path / "six.csv").write_text(
        f"draw_date,draw_number,{','.join(six_names)},source\n2029-08-09,12,{','.join(map(str, range(31, 38)))},by hand\n"
    )
    seven_names = [*(f"number{i}" for i in range(1, 8)), "bonus_number1", "bonus_number2"]
    (tmp_path / "seven.csv").write_text(f"draw_no,draw_date,{','.join(seven_names)}\n13,2029-08-10,{','.join(map(str, range(1, 9)))},\n")
    six = files.read_legacy_csv(spark, str(tmp_path / "six.csv"), "loto6").first()
    assert (six.lottery_type, six.draw_no, six.n6, six.n7, six.b1, six.b2, six.source_url) == ("loto6", 12, 36, None, 37, None, "by hand")
    assert six.source_file_name == "six.csv"
    seven = files.read_legacy_csv(spark, str(tmp_path / "seven.csv"), "loto7").first()
    assert (seven.draw_no, seven.n7, seven.b1, seven.b2) == (13, 7, 8, None)
    with pytest.raises(ValueError, match="n7"):
        files.read_legacy_csv(spark, str(tmp_path / "six.csv"), "loto7")


def test_jsonl_filters_type_skips_blanks_and_reports_bad_lines(spark, tmp_path):
    path = tmp_path / "h.jsonl"
    path.write_text('{"lottery_type": "LOTO6", "draw_no": 3, "n1": 1}\n\n{"lottery_type": "loto7", "draw_no": 4}\n')
    assert [r.draw_no for r in files.read_jsonl(spark, str(path), "loto6").collect()] == [3]
    path.write_text('{"lottery_type": "loto6", "draw_no": 3}\n{broken\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(path), "loto6").collect()
    kept = files.read_jsonl(spark, str(path), strict=False).cache()
    assert kept.filter("_corrupt_record is not null").count() == 1


def test_empty_backfill_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no draw"):
        files.save_backfill(draw_rows(spark).limit(0), str(tmp_path / "x"))


def test_wide_and_array_forms_are_inverse(spark, small):
    d = fixtures.draws(spark, small).drop("series", "status")
    back = project.to_arrays(project.to_wide(d)).select(*d.columns)
    assert d.exceptAll(back).isEmpty() and back.exceptAll(d).isEmpty()


def test_missing_main_number_fails_the_conversion(spark):
    wide = project.to_wide(draw_rows(spark)).withColumn("n3", F.lit(None).cast("int"))
    with pytest.raises(Exception, match="missing main number"):
        project.to_arrays(wide).collect()


def test_validation_names_every_broken_rule(spark):
    rows = spark.createDataFrame(
        [
            (" LOTO6 ", 1, "2026/4/2", [1, 2, 3, 4, 5, 6], [7]),
            ("loto6", 0, "2026-02-30", [1, 1, 3, 4, 5, 44], [3, 9]),
            ("mini", 5, "2026-01-01", [1], []),
            ("loto7", 6, None, None, [1, 2]),
        ],
        "lottery_type string, draw_no int, draw_date string, main_numbers array<int>, bonus_numbers array<int>",
    )
    got = {r.draw_no: list(r.errors) for r in validate.with_errors(rows).collect()}
    assert got[1] == []
    assert got[0] == ["draw_no_not_positive", "bonus_count", "out_of_range", "duplicate_main", "duplicate_number", "bad_date"]
    assert got[5] == ["unsupported_type"]
    assert got[6] == ["main_count", "bad_date"]
    good, bad = validate.split_valid(rows)
    assert [str(r.draw_date) for r in good.collect()] == ["2026-04-02"] and bad.count() == 3
    with pytest.raises(Exception, match="invalid draw"):
        validate.split_valid(rows, on_error="stop")[0].collect()


def test_required_fields(spark):
    rows = spark.createDataFrame([("a", 1), ("", 2), (None, None)], "x string, y int")
    good, bad = validate.require_fields(rows, ["x", "y"])
    assert good.count() == 1
    assert sorted(",".join(r.missing) for r in bad.collect()) == ["x", "x,y"]


def test_jsonl_table_appends_only_new_draws(spark, tmp_path):
    path = str(tmp_path / "table")
    make = lambda *numbers: spark.createDataFrame([("loto6", n) for n in numbers], "lottery_type string, draw_no bigint")
    files.append_new_jsonl(spark, make(1, 2), path)
    files.append_new_jsonl(spark, make(2, 3, None), path)
    got = [r.draw_no for r in files.read_jsonl(spark, path, "loto6").collect()]
    assert sorted(n for n in got if n) == [1, 2, 3] and got.count(None) == 1


def test_backfill_is_written_in_order(spark, small, tmp_path):
    path = str(tmp_path / "sorted")
    d = fixtures.draws(spark, small).repartition(5)
    files.save_backfill(d, path)
    lines = [line for f in sorted((tmp_path / "sorted").glob("part-*.csv")) for line in f.read_text().splitlines()[1:]]
    keys = [(line.split(",")[0], int(line.split(",")[1])) for line in lines]
    assert len(keys) == d.count() and keys == sorted(keys)


def test_every_row_is_usable_or_has_a_reason(spark, small):
    wide = project.to_wide(fixtures.written_pools(fixtures.faulty_draws(spark, small))).withColumn("draw_no", F.col("draw_no").cast("string"))
    usable, rest = project.normalise_rows(wide)
    assert usable.count() + rest.count() == wide.count()
    assert {r.reason for r in rest.select("reason").distinct().collect()} == {"unknown_pool", "no_draw_no"}


def test_only_files_with_broken_lines_are_read_whole(spark, tmp_path):
    folder = tmp_path / "in put"
    folder.mkdir()
    head, line = ",".join(files.CSV_COLUMNS), "loto6,{},2026-01-02,1,2,3,4,5,6,,9,,{}"
    plain = [line.format(k, f"u{k}" if k % 2 else f'"say ""{k}"", twice"') for k in range(20_000)]
    (folder / "plain.csv").write_text("\n".join([head, *plain]) + "\n")
    broken = [line.format(100_000 + k, f'"two\nlines, {k} ""x"""') for k in range(50)]
    (folder / "broken.csv").write_text("\n".join([head, *broken]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        only = files.read_canonical_csv(spark, str(folder / "plain.csv"))
        assert only.rdd.getNumPartitions() > 8
        for mixed in (False, True):
            rows = {r.draw_no: r.source_url for r in files.read_canonical_csv(spark, str(folder), mixed_headers=mixed).collect()}
            assert len(rows) == 20_050 and rows[100_007] == 'two\nlines, 7 "x"'
            assert rows[4] == 'say "4", twice' and rows[5] == "u5"
        both = files.read_canonical_csv(spark, str(folder))
        assert both.rdd.getNumPartitions() >= only.rdd.getNumPartitions() + 1
        alone = files.read_canonical_csv(spark, str(folder / "broken.csv"))
        assert alone.count() == 50 and alone.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_legacy_files_keep_their_names_in_a_mixture(spark, tmp_path):
    head = "draw_number,draw_date,number1,number2,number3,number4,number5,number6,bonus_number,source"
    (tmp_path / "a.csv").write_text(head + "\n1,2029-08-10,1,2,3,4,5,6,7,x\n")
    (tmp_path / "b.csv").write_text(head + '\n2,2029-08-11,1,2,3,4,5,6,7,"y\nz"\n')
    rows = {r.draw_no: (r.source_file_name, r.source_url) for r in files.read_legacy_csv(spark, str(tmp_path), "loto6").collect()}
    assert rows == {1: ("a.csv", "x"), 2: ("b.csv", "y\nz")}
