"""Toxicity by multiple-instance learning: only documents have labels, sentences get scores.

A sentence's logit is a weighted sum of its hashed words and word beginnings. A document is toxic unless
every sentence is clean: P = 1 - prod(1 - p_s), the noisy-or. With softplus(z) =
-log(1 - p), the sum A of softplus over the sentences gives P = 1 - exp(-A), so the
gradient of the document loss reaches each sentence through sigmoid(z_s).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ready, span_hashes, utf8, word_bounds
from .labelled import labelled_sample, remainder, sigmoid
from .quality import LOWER, NOT_ALNUM

WORD_BITS = 18
# Bytes of the word beginnings that are features beside the whole word, for compounds.
BEGINNINGS = (4, 5, 6, 7)
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Sentences:
    """Sentences of a run of texts that have words: ``at`` bounds those of each text.

    ``features`` are hash buckets, those of sentence i from ``features_at[i]`` on.
    """

    at: np.ndarray
    features_at: np.ndarray
    features: np.ndarray
    opens: np.ndarray
    closes: np.ndarray


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    """Parts texts at ``.!?`` and line ends and hashes the lower-cased words and beginnings of each sentence."""
    starts, ends, at = word_bounds(data, offsets, NOT_ALNUM)
    stops = np.flatnonzero(SENTENCE_END[data])
    # Words of one text with no end of a sentence between them are together.
    passed = np.searchsorted(stops, starts)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.ones(len(starts), bool)
    first[1:] = (passed[1:] != passed[:-1]) | (text[1:] != text[:-1])
    opens = np.flatnonzero(first)
    closes = np.append(opens[1:], len(starts))[: len(opens)]
    # One row of features a word: itself and, if it is longer, each beginning.
    hashed = span_hashes(LOWER[data], starts, [ends, *(np.minimum(starts + k, ends) for k in BEGINNINGS)])
    grid = np.stack(hashed, axis=1) >> np.uint64(64 - WORD_BITS)
    real = np.stack([np.ones(len(starts), bool), *(ends - starts > k for k in BEGINNINGS)], axis=1)
    before = np.concatenate(([0], np.cumsum(real.sum(axis=1))))
    return Sentences(
        np.searchsorted(opens, at),
        before[np.append(opens, len(starts))],
        grid[real].astype(np.int32),
        starts[opens],
        ends[closes - 1],
    )


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    running = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return running[bounds[1:]] - running[bounds[:-1]]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class SentenceModel:
    bias: float
    weights: np.ndarray

    def logits(self, features: np.ndarray, features_at: np.ndarray) -> np.ndarray:
        return self.bias + _sums(self.weights[features], features_at)


class _Fit:
    """Noisy-or log loss of labelled documents, with gradient steps over some of the features."""

    def __init__(self, features: np.ndarray, features_at: np.ndarray, at: np.ndarray, labels: np.ndarray) -> None:
        self.features, self.features_at, self.at, self.labels = features, features_at, at, labels
        self.sentence = np.repeat(np.arange(len(features_at) - 1, dtype=np.int32), np.diff(features_at))
        self.owner = np.repeat(np.arange(len(labels)), np.diff(at))
        self.bias, self.weights = -4.0, np.zeros(1 << WORD_BITS)

    def pull(self, features: np.ndarray, features_at: np.ndarray) -> np.ndarray:
        """Loss gradient of each sentence's logit."""
        z = self.bias + _sums(self.weights[features], features_at)
        odds = np.exp(-np.maximum(_sums(softplus(z), self.at), 1e-6))
        slope = ((1 - self.labels) - self.labels * odds / (1 - odds)) / len(self.labels)
        return slope[self.owner] * sigmoid(z)

    def gradient(self) -> np.ndarray:
        """Loss gradient of every feature's weight."""
        pull = self.pull(self.features, self.features_at)
        return np.bincount(self.features, pull[self.sentence], minlength=len(self.weights))

    def run(self, active: np.ndarray, rounds: int, rate: float, draw: float, shrink: float) -> None:
        """Steps over the active features with an L1 penalty ``draw`` and an L2 penalty ``shrink``."""
        own = active[self.features]
        features, sentence = self.features[own], self.sentence[own]
        features_at = np.concatenate(([0], np.cumsum(np.bincount(sentence, minlength=len(self.features_at) - 1))))
        ids = np.flatnonzero(active)
        squares, bias_square = np.full(len(ids), 1e-8), 1e-8
        for _ in range(rounds):
            pull = self.pull(features, features_at)
            gradient = np.bincount(features, pull[sentence], minlength=len(self.weights))[ids]
            gradient = gradient + shrink * self.weights[ids]
            squares += gradient * gradient
            bias_square += pull.sum() ** 2
            step = rate / np.sqrt(squares)
            moved = self.weights[ids] - step * gradient
            self.weights[ids] = np.sign(moved) * np.maximum(np.abs(moved) - step * draw, 0)
            self.bias -= rate / np.sqrt(bias_square) * pull.sum()


def fit(
    features: np.ndarray,
    features_at: np.ndarray,
    at: np.ndarray,
    labels: np.ndarray,
    rounds: int = 60,
    rate: float = 0.5,
    evidence: float = 4.0,
) -> SentenceModel:
    """Fits by full-batch steps on the noisy-or log loss.

    An L1 penalty worth ``evidence`` documents selects features: one that pulls less
    stays at zero, so rare words of labelled documents aren't learnt by heart. Steps
    run over features whose pull exceeds the penalty only, which are looked for anew
    a few times. The chosen ones are then fitted on with a slight L2 penalty.
    """
    if not len(labels) or labels.min() == labels.max():
        return SentenceModel(4.0 if len(labels) and labels[0] else -8.0, np.zeros(1 << WORD_BITS, np.float32))
    state = _Fit(features, features_at, at, labels)
    draw = evidence / len(labels)
    active = np.zeros(1 << WORD_BITS, bool)
    state.run(active, rounds, rate, 0, 0)
    for _ in range(4):
        active |= np.abs(state.gradient()) > draw
        state.run(active, rounds, rate, draw, 0)
    state.run(state.weights != 0, 2 * rounds, rate, 0, 1e-4)
    return SentenceModel(float(state.bias), state.weights.astype(np.float32))


def _parted(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Sentences]]:
    data, offsets = utf8(batch["text"])
    for start, stop in pieces(offsets):
        a, b = offsets[start], offsets[stop]
        own = offsets[start : stop + 1] - a
        yield start, stop, data[a:b], own, sentences(data[a:b], own)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, _, _, found in _parted(batch):
            sizes = np.diff(found.features_at).astype(np.int32)
            at = found.at
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"][start:stop],
                    batch["label"][start:stop],
                    pa.ListArray.from_arrays(pa.array(found.features_at[at].astype(np.int32)), pa.array(found.features)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sizes)),
                ],
                ["doc_id", "label", "features", "sizes"],
            )


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    folds: int = 3,
    held_out: int = 1,
    most_labelled: int = 4000,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_bytes: int = 32 << 20,
) -> SentenceModel:
    """Fits on at most ``most_labelled`` labelled rows whose CRC-32 remainder isn't ``held_out``.

    Their hashed features, made in Spark from whole texts, are the only rows that reach
    the driver. Their texts have at most ``most_bytes`` together, and each word yields
    a few features of four bytes.
    """
    ready(docs.sparkSession)
    sample = labelled_sample(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
        labels.withColumnRenamed(id_col, "doc_id"),
        label_col,
        remainder("doc_id", folds) != held_out,
        most_labelled,
        most_bytes=most_bytes,
    )
    found = sample.mapInArrow(
        _sample_rows, f"doc_id {dict(sample.dtypes)['doc_id']}, label int, features array<int>, sizes array<int>"
    ).toArrow()
    # Partitions come in any order: sorted, a fit is the same each time.
    found = found.sort_by("doc_id")
    features, sizes = found["features"].combine_chunks(), found["sizes"].combine_chunks()
    running = lambda x: np.concatenate(([0], np.cumsum(x))).astype(np.int64)
    return fit(
        features.flatten().to_numpy(zero_copy_only=False),
        running(sizes.flatten().to_numpy(zero_copy_only=False)),
        running(sizes.value_lengths().to_numpy(zero_copy_only=False)),
        found["label"].to_numpy().astype(np.float64),
    )


def score_toxicity(
    docs: DataFrame,
    model: SentenceModel,
    folds: int = 3,
    held_out: int = 1,
    threshold: float = 0.7,
    offence: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold), offending.

    ``offending`` lists the sentences with a score of ``offence`` or more as byte
    positions in the text's UTF-8 (start, end, score). Texts without words, null
    included, have no sentence and score zero. Rows that repeat get equal scores; rows
    without an id are not held out. Other columns are not read.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, starts, ends, marks, sizes = [np.zeros(0)], [], [], [], [np.zeros(1, np.int64)]
            for _, _, _, own, found in _parted(batch):
                z = shared.value.logits(found.features, found.features_at)
                scores.append(-np.expm1(-_sums(softplus(z), found.at)))
                bad = np.flatnonzero(sigmoid(z) >= offence)
                text = np.searchsorted(found.at, bad, side="right") - 1
                starts.append(found.opens[bad] - own[text])
                ends.append(found.closes[bad] - own[text])
                marks.append(sigmoid(z[bad]))
                sizes.append(np.cumsum(np.bincount(text, minlength=len(own) - 1)) + sizes[-1][-1])
            flat = [np.concatenate(x) if x else np.zeros(0) for x in (starts, ends, marks)]
            spans = pa.StructArray.from_arrays(
                [pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.float64())],
                ["start", "end", "score"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(np.concatenate(scores)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(sizes).astype(np.int32)), spans),
                ],
                ["doc_id", "score", "offending"],
            )

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(
        scored, f"doc_id {kind}, score double, offending array<struct<start:int,end:int,score:double>>"
    ).select(
        "doc_id",
        F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "offending",
    )
