"""Corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. A stage
judges rows, not ids: rows that repeat an id or have none are kept or dropped by their own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.bpe import Tokenizer, ids_digest
from drawlake.llm.common import numbered_rows, ready, saved
from drawlake.llm.decontaminate import decontaminate
from drawlake.llm.line_dedup import remove_repeated_lines
from drawlake.llm.quality import score_quality, train_quality
from drawlake.llm.queries import VOCABULARY, table
from drawlake.llm.simhash import near_duplicates


def _rows(docs: DataFrame) -> DataFrame:
    """Stored rows of ``docs`` under a number of their own: row, doc_id, text, and the other columns in ``carried``.

    Stages that join judge rows by this number, so rows that repeat an id, or have none,
    are rows like others: each stage puts out at most the rows that it got.
    """
    return numbered_rows(docs, carry=[c for c in docs.columns if c != "text"])


def _without(rows: DataFrame, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose number isn't among ``dropped``, with the columns of the documents."""
    kept = rows.join(dropped.select("row"), "row", "left_anti")
    return kept.select(*[F.col("text") if c == "text" else F.col("carried")[c].alias(c) for c in columns])


def _judged(rows: DataFrame) -> DataFrame:
    return rows.select("row", "text", F.col("carried")["n_chars"].alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the quality classifier rejects; every row is scored where it lies."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    kept = score_quality(docs, model, carry=list(docs.columns)).filter("predicted = 1")
    return kept.select("carried.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines of each row; rows of which nothing is left go."""
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("others")
    cut = remove_repeated_lines(docs, carry=[others, F.col("text").isNull().alias("no_text")]).filter(
        "n_removed = 0 OR n_removed < n_lines"
    )
    changed, rest = F.col("n_removed") > 0, F.col("carried")["others"]
    columns = {
        "text": F.when(~F.col("carried")["no_text"], F.col("kept")),
        "n_chars": F.when(changed, F.length("kept").cast("bigint")).otherwise(rest["n_chars"]),
    }
    return cut.select(*[columns.get(c, rest[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each near-duplicate group; row numbers rise with the ids."""
    rows = _rows(docs)
    groups = near_duplicates(_judged(rows), id_col="row").withColumnRenamed("doc_id", "row")
    return _without(rows, groups.filter("row != component_id"), docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that contain benchmark phrases."""
    rows = _rows(docs)
    found = decontaminate(_judged(rows), table(spark, sf_dir, "benchmark"), id_col="row").withColumnRenamed("doc_id", "row")
    return _without(rows, found.filter("contaminated"), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by decoding them again."""
    tokenizer = Tokenizer(spark, VOCABULARY)
    coded = tokenizer.decode(tokenizer.encode(docs.select("doc_id", "text")).drop("text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_dedup", near_dedup),
    ("leaks", leaks),
    ("tokens", tokens),
]

# The classifier and the tokeniser have no SQL counterpart; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
