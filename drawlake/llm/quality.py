"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Pairwise interactions have low rank: feature i has a vector v_i, and the sum over
all pairs <v_i, v_j> x_i x_j is half of (square of sums - sum of squares) per
dimension, so scoring is linear in the number of features of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ready, utf8, word_bounds, word_hashes
from .labelled import Adam, labelled_sample, remainder, sigmoid

WORD_BITS = 15
STATISTICS = 15
BINS = 32
FEATURES = (1 << WORD_BITS) + STATISTICS * BINS
RANK = 4

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

# Kinds of bytes whose shares describe the structure of a text.
KINDS = 9
KIND = np.zeros(256, np.int64)
KIND[65:91] = 1
KIND[48:58] = 2
KIND[[9, 11, 12, 13, 32]] = 3
KIND[10] = 4
KIND[ord("|")] = 5
KIND[[ord(c) for c in ".,;:'\"-?()"]] = 6
KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{}~"]] = 7
KIND[128:] = 8


@dataclass
class Rows:
    """Features of texts: row bounds, columns and values."""

    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray


def _bins(x: np.ndarray, per_doubling: float = 2.0) -> np.ndarray:
    return np.minimum(np.log2(1 + x) * per_doubling, BINS - 1).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> Rows:
    """Hashed lower-cased words (share of the text's words each) and one bin per statistic."""
    count = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(count), sizes)
    kinds = np.bincount(owner * KINDS + KIND[data], minlength=count * KINDS).reshape(count, KINDS)
    starts, ends, at = word_bounds(data, offsets, NOT_ALNUM)
    hashes = word_hashes(LOWER[data], starts, ends) >> np.uint64(64 - WORD_BITS)
    words = np.diff(at)
    cells, times = np.unique(
        np.repeat(np.arange(count), words) << WORD_BITS | hashes.astype(np.int64), return_counts=True
    )
    row, column = cells >> WORD_BITS, cells & ((1 << WORD_BITS) - 1)
    some = np.maximum(words, 1)
    writer = np.repeat(np.arange(count), words)
    again = (hashes[1:] == hashes[:-1]) & (writer[1:] == writer[:-1])
    shares = 1000 * kinds / np.maximum(sizes, 1)[:, None]
    letters = sizes - kinds[:, 3] - kinds[:, 4]
    statistics = np.stack(
        [
            *(_bins(shares[:, k]) for k in range(1, KINDS)),
            _bins(sizes, 1.0),
            _bins(words, 1.0),
            _bins(letters / some, 4.0),
            _bins(1000 * np.bincount(row, minlength=count) / some),
            _bins(sizes / (kinds[:, 4] + 1), 2.0),
            _bins(1000 * np.bincount(writer[1:][again], minlength=count) / some),
            # Metadata: the length that came with the row.
            _bins(n_chars, 1.0),
        ],
        axis=1,
    )
    extra = (1 << WORD_BITS) + np.arange(STATISTICS) * BINS + statistics
    rows = np.concatenate((row, np.repeat(np.arange(count), STATISTICS)))
    order = np.argsort(rows, kind="stable")
    values = np.concatenate((times / some[row], np.full(count * STATISTICS, 1.0)))
    return Rows(
        np.searchsorted(rows[order], np.arange(count + 1)),
        np.concatenate((column, extra.ravel()))[order].astype(np.int32),
        values[order].astype(np.float32),
    )


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, rows: Rows) -> np.ndarray:
        x = rows.values[:, None]
        v = self.vectors[rows.columns] * x
        # Every row has the statistics, so no row is empty.
        sums = np.add.reduceat(v, rows.bounds[:-1])
        squares = np.add.reduceat(v * v, rows.bounds[:-1])
        linear = np.add.reduceat(self.weights[rows.columns] * rows.values, rows.bounds[:-1])
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)


class _Block:
    """Rows that are fitted together, with their cells in column order for the gradient."""

    def __init__(self, rows: Rows, start: int, stop: int) -> None:
        a, b = rows.bounds[start], rows.bounds[stop]
        self.start, self.stop = start, stop
        self.rows = Rows(rows.bounds[start : stop + 1] - a, rows.columns[a:b], rows.values[a:b])
        self.owner = np.repeat(np.arange(stop - start), np.diff(self.rows.bounds))
        self.order = np.argsort(self.rows.columns, kind="stable")
        columns = self.rows.columns[self.order]
        self.first = np.flatnonzero(np.concatenate(([True], columns[1:] != columns[:-1])))
        self.used = columns[self.first]

    def gradient(self, model: FactorisationMachine, error_of, g_weights: np.ndarray, g_vectors: np.ndarray) -> float:
        """Adds the block's loss gradient; returns that of the bias."""
        x, at = self.rows.values[:, None], self.rows.bounds[:-1]
        v = model.vectors[self.rows.columns] * x
        sums = np.add.reduceat(v, at)
        linear = np.add.reduceat(model.weights[self.rows.columns] * self.rows.values, at)
        z = model.bias + linear + 0.5 * (sums * sums - np.add.reduceat(v * v, at)).sum(axis=1)
        error = error_of(z, self.start, self.stop).astype(np.float32)
        cells = error[self.owner] * self.rows.values
        g_weights[self.used] += np.add.reduceat(cells[self.order], self.first)
        pull = cells[:, None] * (sums[self.owner] - v)
        g_vectors[self.used] += np.add.reduceat(pull[self.order], self.first)
        return float(error.sum())


def fit(
    rows: Rows,
    labels: np.ndarray,
    rounds: int = 80,
    rate: float = 0.03,
    shrink: float = 5e-4,
    seed: int = 7,
    block_rows: int = 1000,
) -> FactorisationMachine:
    """Fits by full-batch gradient steps on the log loss; without both labels, the constant share of ones.

    Gradients are summed over blocks of rows, so the driver holds the cells of one at a time.
    """
    share = float(labels.mean()) if len(labels) else 0.5
    bias = np.array([np.log((share + 1e-3) / (1 - share + 1e-3))], np.float32)
    weights = np.zeros(FEATURES, np.float32)
    vectors = np.zeros((FEATURES, RANK), np.float32)
    if len(labels) and 0 < share < 1:
        vectors += np.random.default_rng(seed).normal(0, 0.02, vectors.shape).astype(np.float32)
        adam = Adam([bias, weights, vectors], rate)
        # The rarer label weighs up to four times as much.
        weight = np.where(labels > 0, 1.0, np.clip(share / (1 - share), 0.25, 4.0))
        error_of = lambda z, a, b: (sigmoid(z) - labels[a:b]) * weight[a:b] / len(labels)
        blocks = [_Block(rows, a, min(a + block_rows, len(labels))) for a in range(0, len(labels), block_rows)]
        for _ in range(rounds):
            model = FactorisationMachine(float(bias[0]), weights, vectors)
            g_weights, g_vectors = shrink * weights, shrink * vectors
            g_bias = sum(b.gradient(model, error_of, g_weights, g_vectors) for b in blocks)
            adam.step([np.array([g_bias], np.float32), g_weights, g_vectors])
    return FactorisationMachine(float(bias[0]), weights, vectors)


def _featured(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Rows]]:
    data, offsets = utf8(batch["text"])
    n_chars = np.maximum(batch["n_chars"].fill_null(0).to_numpy(zero_copy_only=False), 0)
    for start, stop in pieces(offsets):
        a, b = offsets[start], offsets[stop]
        yield start, stop, features(data[a:b], offsets[start : stop + 1] - a, n_chars[start:stop])


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, rows in _featured(batch):
            bounds = pa.array(rows.bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"][start:stop],
                    batch["label"][start:stop],
                    pa.ListArray.from_arrays(bounds, pa.array(rows.columns)),
                    pa.ListArray.from_arrays(bounds, pa.array(rows.values)),
                ],
                ["doc_id", "label", "columns", "values"],
            )


def _inputs(docs: DataFrame, id_col: str, text_col: str, chars_col: str, carry: list | None = None) -> DataFrame:
    chars = F.col(chars_col).cast("bigint") if chars_col in docs.columns else F.lit(0).cast("bigint")
    fields = [F.struct(*carry).alias("carried")] if carry else []
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), chars.alias("n_chars"), *fields)


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    folds: int = 5,
    held_out: int = 0,
    most_labelled: int = 6000,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str = "n_chars",
    most_bytes: int = 64 << 20,
) -> FactorisationMachine:
    """Fits on at most ``most_labelled`` labelled rows whose CRC-32 remainder isn't ``held_out``.

    Their features, made in Spark from whole texts, are the only rows that reach the
    driver. Their texts have at most ``most_bytes`` together, and features take less
    than two bytes per byte of text and a kilobyte per row.
    """
    ready(docs.sparkSession)
    sample = labelled_sample(
        _inputs(docs, id_col, text_col, chars_col),
        labels.withColumnRenamed(id_col, "doc_id"),
        label_col,
        remainder("doc_id", folds) != held_out,
        most_labelled,
        most_bytes=most_bytes,
    )
    found = sample.mapInArrow(
        _sample_rows,
        f"doc_id {dict(sample.dtypes)['doc_id']}, label int, columns array<int>, values array<float>",
    ).toArrow()
    # Partitions come in any order: sorted, a fit is the same each time.
    found = found.sort_by("doc_id")
    columns, values = found["columns"].combine_chunks(), found["values"].combine_chunks()
    sizes = columns.value_lengths().to_numpy(zero_copy_only=False)
    rows = Rows(
        np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
        columns.flatten().to_numpy(zero_copy_only=False),
        values.flatten().to_numpy(zero_copy_only=False),
    )
    return fit(rows, found["label"].to_numpy().astype(np.float32))


def score_quality(
    docs: DataFrame,
    model: FactorisationMachine,
    folds: int = 5,
    held_out: int = 0,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str = "n_chars",
    carry: list | None = None,
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts are scored by their statistics. Rows that repeat get equal
    scores. Rows without an id are not held out. A null length counts as zero. Columns
    in ``carry`` come out beside each row, in the struct ``carried``; no row moves.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, rows in _featured(batch):
                scores.append(sigmoid(shared.value.logits(rows).astype(np.float64)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.concatenate(scores)), *batch.columns[3:]],
                ["doc_id", "score", *batch.schema.names[3:]],
            )

    chosen = _inputs(docs, id_col, text_col, chars_col, carry)
    rest = ["carried"] if carry else []
    schema = chosen.select("doc_id", F.lit(0.0).alias("score"), *rest).schema
    return chosen.mapInArrow(scored, schema).select(
        *rest,
        "doc_id",
        F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
