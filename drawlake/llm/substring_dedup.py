"""Substring dedup: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

1. Every window of ``width`` words holds a smallest rolling hash among its
   sub-windows of ``inner`` words. Windows of equal words share it, so a window whose
   smallest sub-hash occurs at one place only is unique. Spark counts these hashes
   (about one in eight words); this loses no repeated window.
2. Windows whose smallest sub-hash repeats are counted by their own Rabin-Karp hash
   together with a second, independent hash of their bytes (128 bits in all); the
   count keeps the first place of each.
3. A window that isn't the first of its words is removed; overlapping and touching
   windows merge into maximal intervals.

Texts meet the hash lists by document, so no key holds more than one document's
places; counts combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered_rows, pieces, ready, saved, utf8, window_hashes, word_bounds, word_hashes


class Words:
    """Words of a run of texts: bytes, bounds and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        self.starts, self.ends, self.at = word_bounds(data, offsets)
        self.hashes = word_hashes(data, self.starts, self.ends)

    def windows(self, width: int) -> np.ndarray:
        """Starts of the windows that lie inside one text."""
        counts = np.diff(self.at)
        last = np.repeat(self.at[1:], counts) - width
        return np.flatnonzero(np.arange(len(self.starts)) <= last)


def smallest_inner(words: Words, width: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the texts, the smallest inner hash of each, and the leftmost word where it stands."""
    windows = words.windows(width)
    least = window_hashes(words.hashes, inner)
    place = np.arange(len(least))
    span, done = width - inner + 1, 1
    while done < span and len(least):
        step = min(done, span - done)
        lower = least[step:] < least[:-step]
        least = np.where(lower, least[step:], least[:-step])
        place = np.where(lower, place[step:], place[:-step])
        done += step
    return windows, least[windows], place[windows]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, Words]]:
    """Row of the first text, and the words, of runs of texts of bounded size."""
    data, offsets = utf8(batch["text"])
    for start, stop in pieces(offsets):
        a, b = offsets[start], offsets[stop]
        yield start, Words(data[a:b], offsets[start : stop + 1] - a)


def _inner_hashes(width: int, inner: int):
    """Per text its smallest inner hashes, each with the number of places, two at most, that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for start, words in _runs(batch):
                windows, least, place = smallest_inner(words, width, inner)
                if not len(windows):
                    continue
                # Places only move on from window to window, so each is met once here.
                fresh = np.ones(len(windows), bool)
                fresh[1:] = place[1:] != place[:-1]
                hashes = least[fresh]
                texts = np.searchsorted(words.at, place[fresh], side="right") - 1
                order = np.lexsort((hashes, texts))
                hashes, texts = hashes[order], texts[order]
                opens = np.ones(len(hashes), bool)
                opens[1:] = (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])
                at = np.flatnonzero(opens)
                places = np.minimum(np.diff(np.append(at, len(hashes))), 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[at].view(np.int64)), pa.array(ids[start + texts[at]]), pa.array(places)],
                    ["hash", "doc_id", "places"],
                )

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and n + 1 offsets of an Arrow list column; null counts as empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _candidates(batch: pa.RecordBatch, width: int, inner: int) -> Iterator[tuple[int, Words, list[np.ndarray]]]:
    """Runs of texts with, per text, the windows (as word positions in the run) that may repeat."""
    values, bounds = _lists(batch["hashes"])
    values = values.view(np.uint64)
    for start, words in _runs(batch):
        windows, least, _ = smallest_inner(words, width, inner)
        cuts = np.searchsorted(windows, words.at)
        found = []
        for i in range(len(words.at) - 1):
            wanted = values[bounds[start + i] : bounds[start + i + 1]]
            own = slice(cuts[i], cuts[i + 1])
            found.append(windows[own][np.isin(least[own], wanted)] if len(wanted) else windows[:0])
        yield start, words, found


def _window_keys(width: int, inner: int):
    """Candidate windows of every text: both hashes, id, and word position; the first of each kind in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(zero_copy_only=False), batch["text"]
            for start, words, found in _candidates(batch, width, inner):
                rolling, rows = window_hashes(words.hashes, width), []
                for i, windows in enumerate(found):
                    if not len(windows):
                        continue
                    own = (texts[start + i].as_py() or "").encode().split()
                    line = b" ".join(own)
                    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
                    position = windows - words.at[i]
                    opens = np.where(position > 0, ends[position - 1] + 1, 0).tolist()
                    closes = ends[position + width - 1].tolist()
                    second = np.frombuffer(
                        b"".join([xxhash.xxh3_64_digest(line[a:b]) for a, b in zip(opens, closes)]), np.uint64
                    )
                    own_rolling = rolling[windows]
                    # Stable order by both hashes: the first of each kind is the earliest.
                    order = np.lexsort((second, own_rolling))
                    a, b = own_rolling[order], second[order]
                    opens_kind = np.ones(len(order), bool)
                    opens_kind[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                    first = order[opens_kind]
                    rows.append((own_rolling[first], second[first], np.full(len(first), ids[start + i]), position[first]))
                if rows:
                    h1, h2, doc, place = (np.concatenate(x) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32))],
                        ["h1", "h2", "doc_id", "position"],
                    )

    return run


def merged_intervals(windows: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals (start, end) of words that the sorted windows cover."""
    if not len(windows):
        return np.zeros((0, 2), np.int32)
    opens = np.flatnonzero(np.concatenate(([True], windows[1:] > windows[:-1] + width)))
    closes = np.append(opens[1:], len(windows)) - 1
    return np.stack((windows[opens], windows[closes] + width), axis=1).astype(np.int32)


def _removals(width: int, inner: int):
    """Word counts, removal intervals and kept words of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            firsts, bounds = _lists(batch["firsts"])
            n_words, n_removed, kept, spans, sizes = [], [], [], [], [0]
            for start, words, found in _candidates(batch, width, inner):
                for i, windows in enumerate(found):
                    own = (texts[start + i].as_py() or "").encode().split()
                    position = windows - words.at[i]
                    first = firsts[bounds[start + i] : bounds[start + i + 1]]
                    out = merged_intervals(position[~np.isin(position, first)], width)
                    gone = np.zeros(len(own), bool)
                    for a, b in out:
                        gone[a:b] = True
                    n_words.append(len(own))
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join(compress(own, ~gone) if len(out) else own))
                    spans.append(out)
                    sizes.append(sizes[-1] + len(out))
            flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "removed", "kept"],
            )

    return run


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, inner: int = 6
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed (intervals of word positions), kept (text).

    Words are parted at ASCII white space and left as they are. A window is ``width``
    consecutive words of one row's text. Every word of a window whose words also start
    earlier (smaller id, or earlier in the text) is removed; windows are judged on
    the input. Kept words are joined by one space. Null and short texts have no
    window. Ids are whole numbers. Rows that repeat an id are rows of their own, ordered
    by a hash of the text; of rows alike in both one is the first. Rows without an id
    stay whole and are earlier than nothing. Other columns are not read.
    """
    ready(docs.sparkSession)
    # The row number takes the place of the id: it keeps its order and is unique.
    table = numbered_rows(docs, id_col, text_col)
    known = table.filter("doc_id IS NOT NULL").select(F.col("row").alias("doc_id"), "text")
    inner_hashes = known.mapInArrow(_inner_hashes(width, inner), "hash long, doc_id long, places int")
    repeated = saved(
        inner_hashes.groupBy("hash").agg(F.sum("places").alias("places")).filter("places > 1").select("hash"),
        "repeated-hashes",
    )
    # A hash of a third of all documents is split here: both sides are plain shuffles.
    marked = inner_hashes.select("hash", "doc_id").join(repeated, "hash", "left_semi")
    hashes = saved(marked.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes")), "document-hashes")
    keys = known.join(hashes, "doc_id").mapInArrow(
        _window_keys(width, inner), "h1 long, h2 long, doc_id long, position int"
    )
    firsts = saved(
        keys.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("doc_id"), F.min_by("position", "doc_id").alias("position"))
        .groupBy("doc_id")
        .agg(F.collect_list("position").alias("firsts")),
        "first-places",
    )
    # A window that may repeat and is not the first of its words repeats an earlier one.
    noted = hashes.join(firsts, "doc_id", "left").withColumnRenamed("doc_id", "row")
    return (
        table.join(noted, "row", "left")
        .select("doc_id", "text", "hashes", "firsts")
        .mapInArrow(
            _removals(width, inner),
            "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string",
        )
    )
