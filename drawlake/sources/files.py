"""CSV and JSON-lines readers and writers for draws and runs."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, Observation, SparkSession, functions as F, types as T

from drawlake.operators.project import to_wide
from drawlake.sources.history import existing_keys
from drawlake.spec import BONUS_COLUMNS, CSV_COLUMNS, MAIN_COLUMNS, NULL_MARKER, check_pool

INT_COLUMNS = ["draw_no", *MAIN_COLUMNS, *BONUS_COLUMNS]

# Column names of the older CSV exports and what they map to.
LEGACY_NAMES = {
    "draw_number": "draw_no",
    **{f"number{i}": f"n{i}" for i in range(1, 8)},
    "bonus_number": "b1",
    "bonus_number1": "b1",
    "bonus_number2": "b2",
    "bonus1": "b1",
    "bonus2": "b2",
    "source": "source_url",
}

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("lottery_type", T.StringType()),
        T.StructField("draw_no", T.LongType()),
        T.StructField("draw_date", T.StringType()),
        *[T.StructField(c, T.IntegerType()) for c in [*MAIN_COLUMNS, *BONUS_COLUMNS]],
        T.StructField("source_url", T.StringType()),
    ]
)


def _csv_reader(spark: SparkSession, whole: bool) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("multiLine", whole)
        .option("nullValue", NULL_MARKER)
        .option("escape", '"')
        .option("enforceSchema", False)
    )


def _files_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: its header line, and whether a quoted cell goes on in the next line.

    That is so exactly if some line has an odd number of quotes. One pass over the text,
    with as many tasks as it has splits; lines combine to files before the shuffle.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value"
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.groupBy("file").agg(
        F.min_by("value", "line").alias("head"), F.max(quotes % 2 == 1).alias("broken")
    )


def _read_text_columns(
    spark: SparkSession, path: str | list[str], broken: bool | None = None, file_col: str | None = None
) -> DataFrame:
    """All columns as text, no type inference pass; ``file_col`` adds the name of a row's file.

    The header of one file fixes the column order; a file with another order
    fails instead of being read into the wrong columns. Only files with line breaks
    inside quoted cells are read whole, each by one task; all others are split.
    """
    groups = {broken: path}
    if broken is None:
        # A path per file reaches the driver, like its listing.
        found = _files_of(spark, path).groupBy("broken").agg(F.collect_list("file").alias("files")).collect()
        # Without a mixture the path is read as it was given.
        groups = {g.broken: [unquote(f) for f in g.files] for g in found} if len(found) > 1 else {
            found[0].broken if found else True: path
        }
    schema = _csv_reader(spark, True).csv(path).schema
    parts = [_csv_reader(spark, whole).schema(schema).csv(files) for whole, files in groups.items()]
    if file_col:
        parts = [p.withColumn(file_col, F.col("_metadata.file_name")) for p in parts]
    return reduce(DataFrame.unionByName, parts)


def _by_header(spark: SparkSession, path: str) -> list[DataFrame]:
    """The files of a folder in groups of equal header lines, each read by its own header."""
    groups = _files_of(spark, path).groupBy("head", "broken").agg(F.collect_list("file").alias("files")).collect()
    return [_read_text_columns(spark, [unquote(f) for f in g.files], g.broken) for g in groups]


def _typed(columns: DataFrame) -> DataFrame:
    empty_to_null = {c: F.nullif(F.col(c), F.lit("")) for c in CSV_COLUMNS}
    return columns.select(
        *[
            (empty_to_null[c].cast("bigint") if c == "draw_no" else empty_to_null[c].cast("int")).alias(c)
            if c in INT_COLUMNS
            else empty_to_null[c].alias(c)
            for c in CSV_COLUMNS
        ]
    )


def read_canonical_csv(spark: SparkSession, path: str, *, mixed_headers: bool = False) -> DataFrame:
    """Canonical CSV by column name; ``\\N`` and empty cells are NULL, bad integers fail.

    With ``mixed_headers`` the files of a folder may order their columns differently.
    """
    parts = _by_header(spark, path) if mixed_headers else [_read_text_columns(spark, path)]
    for raw in parts:
        absent = [c for c in CSV_COLUMNS if c not in raw.columns]
        if absent:
            raise ValueError(f"missing CSV columns: {absent}")
    return reduce(DataFrame.unionByName, [_typed(raw) for raw in parts])


def read_legacy_csv(spark: SparkSession, path: str, lottery_type: str) -> DataFrame:
    """Older exports renamed to the canonical columns, with the source file name."""
    kind = check_pool(lottery_type)
    raw = _read_text_columns(spark, path, file_col="source_file_name")
    names = {old: new for old, new in LEGACY_NAMES.items() if old in raw.columns}
    renamed = raw.withColumnsRenamed(names)
    needed = ["draw_no", "draw_date", *MAIN_COLUMNS[: 6 if kind == "loto6" else 7]]
    absent = [c for c in needed if c not in renamed.columns]
    if absent:
        raise ValueError(f"missing CSV columns: {absent}")
    for column in CSV_COLUMNS:
        if column not in renamed.columns:
            value = F.lit(kind) if column == "lottery_type" else F.lit(None).cast("string")
            renamed = renamed.withColumn(column, value)
    typed = {
        c: F.nullif(F.col(c), F.lit("")).cast("bigint" if c == "draw_no" else "int")
        for c in INT_COLUMNS
    }
    return renamed.withColumns(typed).select(*CSV_COLUMNS, "source_file_name")


def write_canonical_csv(draws: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """13 fixed columns, ISO dates, ``\\N`` for missing values, minimal quoting."""
    wide = to_wide(draws) if "main_numbers" in draws.columns else draws
    (
        wide.select(
            *[
                F.coalesce(F.col(c), F.lit("")).alias(c)
                if c in ("lottery_type", "source_url")
                else F.col(c).cast("string").alias(c)
                for c in CSV_COLUMNS
            ]
        )
        .write.mode(mode)
        .option("header", True)
        .option("nullValue", NULL_MARKER)
        .option("emptyValue", "")
        .option("escape", '"')
        .csv(path)
    )


def save_backfill(draws: DataFrame, path: str) -> None:
    """Write harvested draws in order of pool and draw number; an empty result is an error.

    Sorting is by range, so files are ordered and no task holds all rows. The rows are
    counted while they are written: the harvest runs once.
    """
    seen = Observation("backfill")
    ordered = draws.repartitionByRange("lottery_type", "draw_no").sortWithinPartitions("lottery_type", "draw_no")
    write_canonical_csv(ordered.observe(seen, F.count(F.lit(1)).alias("rows")), path)
    if not seen.get["rows"]:
        raise ValueError("the harvest holds no draw")


def read_jsonl(
    spark: SparkSession,
    path: str,
    lottery_type: str | None = None,
    *,
    schema: T.StructType = HISTORY_SCHEMA,
    strict: bool = True,
) -> DataFrame:
    """JSON lines with a fixed schema; a bad line fails, or with ``strict=False``
    is kept in ``_corrupt_record``. Blank lines are skipped."""
    if strict:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
        rows = spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)
    if lottery_type is None:
        return rows
    return rows.filter(F.lower("lottery_type") == check_pool(lottery_type))


def append_new_jsonl(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Append rows whose (lottery_type, draw_no) the JSON-lines table does not hold.

    Unnumbered rows cannot be duplicates and are kept.
    """
    try:
        known = read_jsonl(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        write_jsonl(rows, path, mode="append")
        return
    fresh = rows.join(existing_keys(known, rows), ["lottery_type", "draw_no"], "left_anti")
    write_jsonl(fresh, path, mode="append")


def write_jsonl(rows: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)
