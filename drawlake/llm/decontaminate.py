"""Benchmark decontamination with a distributed positional inverted index; DataFrame functions only.

1. Texts are cut into words once; the stored word table has a number per row.
2. Benchmark items become phrases. Spark counts how often their terms occur in the corpus.
3. Each phrase is anchored at its rarest term. The postings of the anchors are stored:
   term, row, position and the words around it, that is the neighbouring entries of the
   lists of the other terms.
4. A posting moved by the anchor's offset gives the phrase's start; it matches if the
   words at the other offsets are the phrase's. For proximity, all words of the phrase
   must stand within its length plus ``slop`` words.

Terms meet the corpus as broadcast blocks of bounded size, so postings never shuffle
by term and a frequent term can't gather in one task.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, saved

# Words of texts that aren't lower-cased yet. A class that lists what is in takes a seventh
# of the time of one that lists what is out.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def plain(word: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(word, UPPER, LOWER)


def term_of(word: Column) -> Column:
    """Index term of a word: coarser than ``plain`` (all letters lower-cased) and faster; matches are checked by words."""
    return F.lower(word)


def phrases_of(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct phrases (words, items): every ``size`` consecutive words of an item, or all of a shorter one."""
    words = items.select(
        F.col(id_col).alias("item_id"), F.transform(words_of(F.col(text_col)), plain).alias("all_words")
    ).filter(F.size("all_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all_words") - size + 1, F.lit(1)))
    return (
        words.select("item_id", "all_words", F.explode(starts).alias("start"))
        .select("item_id", F.slice("all_words", F.col("start"), size).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item_id").alias("items"))
    )


def _blocks(frame: DataFrame, key: str, most_rows: int, most_chars: int, chars: Column) -> list[DataFrame]:
    """``frame`` in blocks that are small enough to broadcast, by a hash of ``key``."""
    rows, total = frame.agg(F.count(F.lit(1)), F.sum(chars)).first()
    count = max(1, ceil(rows / most_rows), ceil((total or 0) / most_chars))
    if count == 1:
        return [frame]
    return [frame.filter(F.pmod(F.xxhash64(key), F.lit(count)) == b) for b in range(count)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _spans(start_of) -> Column:
    """The phrases of a posting that stand there, as (start, length, items); ``start_of`` gives -1 for the others."""
    tried = F.transform(
        "anchored",
        lambda a: F.struct(start_of(a).alias("start"), F.size(a["words"]).alias("length"), a["items"].alias("items")),
    )
    return F.filter(tried, lambda m: m["start"] >= 0)


def _word_for_word(a: Column) -> Column:
    start = F.col("pos") - a["offset"]
    there = F.slice("around", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.size(a["words"]))
    return F.when((start >= 0) & (there == a["words"]), start).otherwise(-1)


def _within(slop: int):
    def earliest(a: Column) -> Column:
        span = F.size(a["words"]) + slop
        fits = F.filter(
            F.sequence(F.greatest(F.col("pos") - span + 1, F.lit(0)), F.col("pos")),
            lambda s: F.size(F.array_except(a["words"], F.slice("around", s - F.col("low") + 1, span))) == 0,
        )
        return F.coalesce(F.array_min(fits), F.lit(-1))

    return earliest


def word_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Words of every row, cut once and stored: row, doc_id, n_words, line (the words, parted by spaces).

    One string takes much less memory than a list of strings in the readers and writers of columns.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    counted = words.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.array_join("words", " ").alias("line"),
    )
    return saved(counted, "words", "zstd")


def build_index(
    table: DataFrame, phrases: DataFrame, slop: int = 0, block_terms: int = 50_000, block_chars: int = 16 << 20
) -> DataFrame:
    """Stored postings of the phrases' rarest terms in a word table: row, pos, low, around, anchored.

    ``around`` are the words from position ``low`` on that a phrase anchored at ``pos``
    can reach, ``anchored`` the phrases (offset, words, items) of the term.
    """
    phrases = saved(phrases.withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    placed = phrases.select("phrase", F.posexplode("words").alias("offset", "word")).select(
        "phrase", "offset", term_of(F.col("word")).alias("term")
    )
    table = table.filter("n_words > 0").select("row", F.split("line", " ").alias("words"))
    terms = saved(placed.select("term").distinct(), "terms")
    seen = table.select(F.explode("words").alias("word")).select(term_of(F.col("word")).alias("term"))
    counts = [
        seen.join(F.broadcast(block), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        for block in _blocks(terms, "term", block_terms, block_chars, F.length("term"))
    ]
    # Terms that the corpus lacks have no count; a phrase with such a term can't occur.
    rarest = F.struct("n", "term", "offset")
    chosen = (
        placed.join(saved(_union(counts), "term-counts"), "term")
        .groupBy("phrase")
        .agg(F.count(F.lit(1)).alias("present"), F.min(rarest).alias("rarest"))
        .join(phrases, "phrase")
        .filter(F.col("present") == F.size("words"))
        .groupBy("rarest.term")
        .agg(F.collect_list(F.struct("rarest.offset", "words", "items")).alias("anchored"))
    )
    anchors = saved(chosen, "anchors")
    cost = F.aggregate("anchored", F.lit(0), lambda n, a: n + F.length(F.array_join(a["words"], " ")))
    reach = (phrases.agg(F.max(F.size("words"))).first()[0] or 1) - 1 + slop
    posted = table.select("row", "words", F.posexplode("words").alias("pos", "word"))
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    near = F.transform(F.slice("words", low + 1, F.col("pos") - low + reach + 1), plain)
    postings = [
        posted.join(F.broadcast(block), term_of(F.col("word")) == F.col("term")).select(
            "row", "pos", low.alias("low"), near.alias("around"), "anchored"
        )
        for block in _blocks(anchors, "term", block_terms, block_chars, cost)
    ]
    return saved(_union(postings), "postings")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    slop: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    **limits: int,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, contaminated, spans.

    A-Z are lower-cased, words are runs of ASCII digits and letters and of all
    characters beyond ASCII. Every ``size`` consecutive words of an item are a phrase,
    a shorter item is one phrase, an item without words none. A document word inside
    an occurrence of a phrase is hit; ``spans`` are the occurrences (start, length),
    ``items`` the ids, as sorted strings, of the items with an occurring phrase. With
    ``slop`` an occurrence is a span of up to ``size + slop`` words that holds all words
    of the phrase. Null texts have no words. Items without an id hit words and are not
    listed; items that repeat an id count once. Every row is judged by its own words,
    also where rows repeat a document's id or have none. Other columns are not read.
    """
    ready(docs.sparkSession)
    table = word_table(docs, id_col, text_col)
    index = build_index(table, phrases_of(items, size, item_col, item_text_col), slop, **limits)
    found = index.select("row", _spans(_within(slop) if slop else _word_for_word).alias("found"))
    # A row's occurrences are at most one per word and phrase length.
    matches = found.filter(F.size("found") > 0).groupBy("row").agg(F.flatten(F.collect_list("found")).alias("found"))
    spans = F.array_sort(
        F.array_distinct(F.transform("found", lambda m: F.struct(m["start"], (m["length"] + slop).alias("length"))))
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("total")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["start"] + s["length"]).alias("upto"),
            (a["total"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["upto"], s["start"]))).alias("total"),
        ),
        lambda a: a["total"],
    )
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda m: m["items"].cast("array<string>")))))
    hits = matches.select("row", spans.alias("spans"), listed.alias("items")).select(
        "row", "spans", "items", covered.alias("n_hit")
    )
    none = F.array().cast("array<string>")
    no_span = F.array().cast("array<struct<start:int,length:int>>")
    return table.select("row", "doc_id", "n_words").join(hits, "row", "left").select(
        "doc_id",
        "n_words",
        F.least(F.coalesce(F.col("n_hit").cast("bigint"), F.lit(0)), F.col("n_words")).alias("n_hit"),
        F.coalesce(F.size("items").cast("bigint"), F.lit(0)).alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("spans", no_span).alias("spans"),
    )
