"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Tokenizer, ids_digest
from .chat import format_chats
from .decontaminate import decontaminate
from .exact_dedup import exact_duplicates
from .line_dedup import remove_repeated_lines
from .mix import mix_sources
from .negatives import hard_negatives
from .quality import score_quality, train_quality
from .simhash import near_duplicates
from .substring_dedup import remove_repeated_windows
from .toxicity import score_toxicity, train_toxicity
from .url_filter import filter_urls
from .whiten import whiten

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    tokenizer = Tokenizer(spark, VOCABULARY)
    coded = tokenizer.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokenizer.decode(coded.drop("text")).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that benchmark phrases cover."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines, as digests."""
    return remove_repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated 20-word windows, as digests."""
    return remove_repeated_windows(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal documents and the one of each group that stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents and their offending sentences."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of each document."""
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "source"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding; some labels are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixteen whitened components of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_decontamination,
        op3_url_filter,
        op4_line_dedup,
        op5_simhash,
        op6_substring_dedup,
        op7_chat_format,
        op8_exact_dedup,
        op9_quality,
        op10_toxicity,
        op11_mix,
        op12_hard_negatives,
        op13_whitening,
    )
}
