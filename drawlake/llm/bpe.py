"""BPE encoding and decoding by a trie of distinct words.

A prefix of a word ends in exactly one token such that the encodings of the prefix
and of the shorter prefix before that token fit together. So the encoding of every
prefix is a link to a shorter one, and a depth-first walk over the trie of distinct
words finds the last token of each prefix once, however many words share it.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, ready, utf8, word_hashes

# Encodings, in bytes, and answered steps, in entries of about 100 bytes, that a worker keeps;
# a table that is full starts anew.
KEPT_BYTES = 36 << 20
KEPT_STEPS = 600_000
# Characters of a text, and ids of a list, that are worked on at once; longer ones are cut at words.
CHUNK = 1 << 18


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
CLASSES = {LETTER: r"\p{L}", NUMBER: r"\p{N}", SPACE: r"\s"}
# Fixed: the endings that vocabularies of this kind part from a word.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(maxsize=1)
def character_classes() -> list[tuple[int, int, int]]:
    """(class, first, last) of the letters, numbers and spaces, as the tokenizers library counts them.

    Asked of the library itself, because Unicode versions differ between engines.
    """
    from tokenizers import Regex, pre_tokenizers

    codes = (*range(0xD800), *range(0xE000, 0x110000))
    every, found = "".join(map(chr, codes)), []
    for kind, pattern in CLASSES.items():
        # What remains are the other characters; the gaps between the runs are the class.
        runs = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed").pre_tokenize_str(every)
        edges = [0, *(x for _, span in runs for x in span), len(every)]
        found += [(kind, codes[a], codes[b - 1]) for a, b in zip(edges[::2], edges[1::2]) if a < b]
    return found


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> dict:
    """What tasks need of a byte-level BPE file; a few megabytes, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    spell = lambda token: bytes(byte_of[c] for c in token)
    merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    return {
        "classes": character_classes(),
        "ids": {spell(t): i for t, i in file["model"]["vocab"].items()},
        "merges": [(spell(a), spell(b)) for a, b in merges],
        "added": {t["content"]: t["id"] for t in file["added_tokens"]},
    }


class WordSplitter:
    """Parts texts into words: runs of letters, numbers or other characters, each with one space before it."""

    def __init__(self, classes: list[tuple[int, int, int]]) -> None:
        self.table = np.zeros(0x110000, np.uint8)
        for kind, first, last in classes:
            self.table[first : last + 1] = kind

    def starts(self, text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First characters of the words, which tile the text, and the bytes of each character.

        ``text`` is several texts in one, beginning at ``bounds``; words don't cross them.
        """
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.table[codes]
        inner = bounds[bounds < len(codes)]
        opens = np.ones(len(codes), bool)
        opens[1:] = kind[1:] != kind[:-1]
        # A space goes with the run after it; other white space there stands alone.
        before_run = opens[1:] & (kind[:-1] == SPACE) & (kind[1:] != SPACE)
        before_run[inner[inner > 0] - 1] = False
        spaced = np.flatnonzero(before_run)
        opens[spaced] = True
        opens[spaced[codes[spaced] == 0x20] + 1] = False
        opens[inner] = True
        # An apostrophe that begins a word on its own takes certain endings with it.
        marks = np.flatnonzero(opens & (codes == 0x27))
        limits = np.append(inner, len(codes))[np.searchsorted(inner, marks, side="right")]
        for at, limit in zip(marks.tolist(), limits.tolist()):
            for ending in ENDINGS:
                stop = at + len(ending)
                if stop <= limit and text.startswith(ending, at):
                    opens[at + 1 : stop] = False
                    if stop < limit:
                        opens[stop] |= kind[stop] == LETTER
                    break
        sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        return np.flatnonzero(opens), sizes


# A space between two characters that aren't white space opens a word, whatever stands around it.
_BORDER = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str, most: int = CHUNK) -> list[str]:
    """``text`` in pieces of about ``most`` characters that begin where a word begins."""
    out, start = [], 0
    while len(text) - start > most and (cut := _BORDER.search(text, start + most)):
        out.append(text[start : cut.start()])
        start = cut.start()
    out.append(text[start:] if start else text)
    return out


class Encoder:
    """Encodes words by walking their trie."""

    def __init__(self, vocabulary: dict) -> None:
        ids, added = vocabulary["ids"], vocabulary["added"]
        self.splitter = WordSplitter(vocabulary["classes"])
        self.added = {text: np.array([i], np.int32) for text, i in added.items()}
        longest = sorted(added, key=len, reverse=True)
        self.split_added = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if added else None
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, tuple[int, int, int]] = {}  # token to (rank, left, right) of the merge that makes it
        for rank, (a, b) in enumerate(vocabulary["merges"]):
            self.rank[ids[a], ids[b]] = rank
            self.born.setdefault(ids[a + b], (rank, ids[a], ids[b]))
        self.size = max([*ids.values(), *added.values()]) + 1
        self.lengths = [0] * self.size
        for spelling, i in ids.items():
            self.lengths[i] = len(spelling)
        self.suffixes = _SuffixAutomaton(ids)
        self.fits: dict[int, bool] = {}
        self.known: dict[bytes, bytes] = {}
        self.known_bytes = 0

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at the left (1) or right (2) edge while ``token`` grows, with the rank at which each is absorbed."""
        out, until = [], len(self.rank)
        while True:
            out.append((token, until))
            if token not in self.born:
                return out
            until, token = self.born[token][0], self.born[token][side]

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together leaves just a and b.

        Follows the tokens left and right of the seam through time. The seam closes if
        two of them that stand there together merge before either is absorbed; among
        equal ranks the merge further left comes first.
        """
        left, right = self._spine(a, 2), self._spine(b, 1)
        i, j = len(left) - 1, len(right) - 1
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if not i and not j:
                return True
            if i and (not j or x_until <= y_until):
                i -= 1
            else:
                j -= 1

    def learn(self, words: list[bytes]) -> None:
        """Adds the encodings of the words to ``known``.

        Sorted words visit their trie depth first: what a word shares with the one
        before it stays on the stack, the rest is dropped and walked anew.
        """
        moves, step = self.suffixes.moves, self.suffixes.step
        longest, shorter, lengths = self.suffixes.longest, self.suffixes.shorter, self.lengths
        fits, size, known = self.fits, self.size, self.known
        states, last = [0], [-1]  # automaton state and last token of each prefix on the path
        before = b""
        for word in sorted(words):
            if len(fits) > KEPT_STEPS:
                fits.clear()
            if len(moves) > KEPT_STEPS:
                moves.clear()
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del states[depth + 1 :], last[depth + 1 :]
            state = states[depth]
            for at in range(depth, len(word)):
                move = state << 8 | word[at]
                state = moves.get(move)
                if state is None:
                    state = step(move)
                states.append(state)
                token = longest[state]
                while start := at + 1 - lengths[token]:
                    seam = last[start] * size + token
                    fit = fits.get(seam)
                    if fit is None:
                        fit = fits[seam] = self._adjacent(last[start], token)
                    if fit:
                        break
                    token = shorter[token]
                last.append(token)
            before = word
            tokens, at = [], len(word)
            while at:
                tokens.append(last[at])
                at -= lengths[last[at]]
            known[word] = array("i", tokens[::-1]).tobytes()
            # Two objects of a dictionary take some 200 bytes besides what they hold.
            self.known_bytes += 200 + len(word) + 4 * len(tokens)

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens, one after the other, and their n + 1 offsets; long texts in chunks."""
        cut = [chunks(t) for t in texts]
        parts = [c for t in cut for c in t]
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
        ids, offsets = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for start, stop in pieces(ends, CHUNK):
            own, at = self._run(parts[start:stop])
            ids.append(own)
            offsets.append(at[1:] + offsets[-1][-1])
        of_text = np.concatenate(([0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))))
        return np.concatenate(ids), np.concatenate(offsets)[of_text]

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts of bounded length together."""
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        if not bounds[-1]:
            return np.zeros(0, np.int32), bounds
        text = "".join(texts)
        opens, sizes = self.splitter.starts(text, bounds[:-1])
        at = np.concatenate(([0], np.cumsum(sizes)))
        starts = at[opens]
        lengths = np.diff(np.append(starts, at[-1]))
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        _, first, which = np.unique(
            word_hashes(data, starts, starts + lengths), return_index=True, return_inverse=True
        )
        # Words tile the bytes: each is compared with the word that stands for its hash.
        exact = (lengths == lengths[first][which]).all() and np.array_equal(
            data, data[np.arange(len(data)) + np.repeat(starts[first][which] - starts, lengths)]
        )
        ends = starts + lengths
        if exact:
            words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        else:
            listed: dict[bytes, int] = {}
            which = np.array(
                [listed.setdefault(raw[a:b], len(listed)) for a, b in zip(starts.tolist(), ends.tolist())]
            )
            words = list(listed)
        if self.known_bytes > KEPT_BYTES:
            self.known.clear()
            self.known_bytes = 0
        self.learn([w for w in words if w not in self.known])
        packed = [self.known[w] for w in words]
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        offsets = np.concatenate(([0], np.cumsum(counts)))[:-1]
        own = counts[which]
        stops = np.concatenate(([0], np.cumsum(own)))
        source = np.repeat(offsets[which] - stops[:-1], own) + np.arange(int(stops[-1]))
        return np.frombuffer(b"".join(packed), np.int32)[source], stops[np.searchsorted(opens, bounds)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their n + 1 offsets."""
        if not any(a in t for t in texts for a in self.added):
            return self._pieces(texts)
        spans = [self.split_added(t) for t in texts]
        ids, ends = self._pieces([s for text in spans for s in text[::2]])
        out, sizes, k = [], [], 0
        for text in spans:
            parts = []
            for i, span in enumerate(text):
                parts.append(self.added[span] if i % 2 else ids[ends[k] : ends[k + 1]])
                k += not i % 2
            out += parts
            sizes.append(sum(map(len, parts)))
        return np.concatenate(out), np.concatenate(([0], np.cumsum(sizes)))


class _SuffixAutomaton:
    """For every string read so far, the longest token that ends it (Aho-Corasick, made as far as it is used)."""

    def __init__(self, ids: dict[bytes, int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.longest: list[int] = [-1]
        self.depth_string: list[bytes] = [b""]
        self.shorter: dict[int, int] = {}
        node_of = {b"": 0}
        for token in sorted(ids, key=len):
            node = 0
            for at, byte in enumerate(token):
                child = self.next[node].get(byte)
                if child is None:
                    child = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.longest.append(-1)
                    self.depth_string.append(token[: at + 1])
                    node_of[token[: at + 1]] = child
                node = child
            self.longest[node] = ids[token]
        own = list(self.longest)
        self.fail = [0] * len(self.next)
        self.moves: dict[int, int] = {}
        for node in sorted(range(1, len(self.next)), key=lambda n: len(self.depth_string[n])):
            text = self.depth_string[node]
            if len(text) > 1:
                parent = node_of[text[:-1]]
                self.fail[node] = self.step(self.fail[parent] << 8 | text[-1])
            below = self.longest[self.fail[node]]
            if own[node] < 0:
                self.longest[node] = below
            elif len(text) > 1:
                self.shorter[own[node]] = below
        del self.depth_string

    def step(self, move: int) -> int:
        """Follows ``state << 8 | byte`` and keeps the way in ``moves``."""
        found = self.next[move >> 8].get(move & 255)
        if found is None:
            found = self.step(self.fail[move >> 8] << 8 | move & 255) if move >> 8 else 0
        self.moves[move] = found
        return found


@lru_cache(maxsize=1)
def _encoder(path: str, vocabulary: Broadcast) -> Encoder:
    return Encoder(vocabulary.value)


@lru_cache(maxsize=1)
def _spellings(path: str, vocabulary: Broadcast) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens in one array, with the start and length of each; all that decoding needs."""
    ids, added = vocabulary.value["ids"], vocabulary.value["added"]
    spelled = {**{i: t for t, i in ids.items()}, **{i: t.encode() for t, i in added.items()}}
    listed = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
    lengths = np.fromiter(map(len, listed), np.int64, len(listed))
    return np.frombuffer(b"".join(listed), np.uint8), np.cumsum(lengths) - lengths, lengths


class Tokenizer:
    """A vocabulary file for use in Spark plans; ``path`` is read on the driver and broadcast (a few megabytes)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        ready(spark)
        vocabulary = load_vocabulary(path)
        self.path = path
        self.vocabulary = spark.sparkContext.broadcast(vocabulary)

    def encode(self, frame: DataFrame, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
        """``frame`` with the ids of the whole text as an array<int> column; null counts as empty.

        Strings of added tokens become their id, as in the library; nothing is put
        before or after a text. A column that is called ``ids_col`` already is replaced.
        """
        path, vocabulary = self.path, self.vocabulary

        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _encoder(path, vocabulary)
            for texts in batches:
                _, offsets = utf8(texts)
                flat, bounds = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
                for start, stop in pieces(offsets, CHUNK):
                    values, ends = encoder.encode([t or "" for t in texts[start:stop].to_pylist()])
                    flat.append(values)
                    bounds.append(ends[1:] + bounds[-1][-1])
                yield pa.ListArray.from_arrays(
                    pa.array(np.concatenate(bounds).astype(np.int32)), pa.array(np.concatenate(flat))
                )

        return frame.withColumn(ids_col, F.arrow_udf(ids, "array<int>")(F.col(text_col)))

    def decode(self, frame: DataFrame, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
        """``frame`` with the text of the ids; special tokens are spelled out, unknown ids spell nothing.

        Bytes that are not UTF-8 become replacement characters. Null counts as no ids.
        """
        path, vocabulary = self.path, self.vocabulary

        def spelled(own: np.ndarray) -> tuple[bytes, np.ndarray]:
            """Bytes of some ids, and where each ends."""
            letters, starts, lengths = _spellings(path, vocabulary)
            valid = (own >= 0) & (own < len(lengths))
            own = np.where(valid, own, 0)
            sizes = np.where(valid, lengths[own], 0)
            closes = np.cumsum(sizes)
            total = int(closes[-1]) if len(closes) else 0
            source = np.repeat(starts[own] - (closes - sizes), sizes) + np.arange(total)
            return letters[source].tobytes(), closes

        def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            # Spark runs this in a worker of its own, which needs no encoder.
            for lists in batches:
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(counts)))
                out = []
                for start, stop in pieces(ends, CHUNK // 2):
                    if stop - start == 1:
                        parts = range(ends[start], ends[stop], CHUNK // 2)
                        raw = b"".join(spelled(ids[at : min(at + CHUNK // 2, ends[stop])])[0] for at in parts)
                        out.append(raw.decode("utf-8", "replace"))
                        continue
                    raw, closes = spelled(ids[ends[start] : ends[stop]])
                    cuts = np.concatenate(([0], closes))[ends[start : stop + 1] - ends[start]].tolist()
                    out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
                yield pa.array(out, pa.string())

        return frame.withColumn(text_col, F.arrow_udf(texts, "string")(F.col(ids_col)))


def ids_digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
