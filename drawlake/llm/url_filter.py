"""URL filters: a sorted digest array, memory-mapped and probed by binary search.

The rule list is packed once: 64-bit xxhash keys in sorted order, and the full
rule strings in the same order. Spark ships the packed files to every executor,
where workers map them and share the pages. A url yields one key per host suffix of
as many labels, and path of as many characters, as some rule has; equal keys are
confirmed against the stored string.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready

Rule = tuple[str, str, str]  # verdict, host, path

# Most rules in one packed array; longer lists become several arrays, probed in turn.
ARRAY_RULES = 8_000_000


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def _pack(rules: list[tuple[str, str]]) -> bytes:
    keyed = sorted((_key(rule), rule, verdict) for rule, verdict in rules)
    texts = [f"{verdict} {rule}".encode() for _, rule, verdict in keyed]
    lengths = sorted({len(rule) - rule.index("/") for rule, _ in rules})
    labels = sorted({rule[: rule.index("/")].count(".") + 1 for rule, _ in rules})
    parts = [
        np.array([len(keyed), len(lengths), len(labels)], np.int64),
        np.array([k for k, _, _ in keyed], np.uint64),
        np.cumsum([0, *map(len, texts)], dtype=np.int64),
        np.array([*lengths, *labels], np.int64),
    ]
    return b"".join([*(p.tobytes() for p in parts), *texts])


def _stored(packed: bytes) -> str:
    """Local file of a packed array, named by its content: equal rules are written and shipped once."""
    path = os.path.join(tempfile.gettempdir(), f"url-rules-{hashlib.sha256(packed).hexdigest()[:32]}")
    if not os.path.exists(path):
        with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as out:
            out.write(packed)
        os.replace(out.name, path)
    return path


def pack_rules(spark: SparkSession, rules: Iterable[Rule], array_rules: int = ARRAY_RULES) -> list[str]:
    """Ships the packed rules to the executors and returns the names of the arrays.

    A rule is verdict, host and a path that starts with ``/``; hosts are lower-cased.
    A host and path given twice keeps its last verdict.
    """
    merged = {host.lower() + path: verdict for verdict, host, path in rules}
    for rule in merged:
        if "/" not in rule:
            raise ValueError(f"the rule {rule!r} has no path")
    listed, names = list(merged.items()), []
    for start in range(0, max(1, len(listed)), array_rules):
        path = _stored(_pack(listed[start : start + array_rules]))
        spark.sparkContext.addFile(path)
        names.append(os.path.basename(path))
    return names


class DigestArray:
    """A packed file, mapped read-only."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        count, lengths, labels = (int(x) for x in raw[:24].view(np.int64))
        at = 24 + 8 * count
        self.keys = raw[24:at].view(np.uint64)
        self.ends = raw[at : at + 8 * (count + 1)].view(np.int64)
        at += 8 * (count + 1)
        # Path lengths, and numbers of host labels, that rules have.
        self.lengths = raw[at : at + 8 * lengths].view(np.int64).tolist()
        at += 8 * lengths
        self.labels = raw[at : at + 8 * labels].view(np.int64).tolist()
        self.texts = raw[at + 8 * labels :]

    def text(self, k: int) -> str:
        return bytes(self.texts[self.ends[k] : self.ends[k + 1]]).decode()

    def find(self, wanted: list[str]) -> dict[int, tuple[str, str]]:
        """Position in ``wanted`` to (verdict, rule) for those that are rules."""
        hashes = np.fromiter(map(_key, wanted), np.uint64, len(wanted))
        at = np.searchsorted(self.keys, hashes)
        hit = np.flatnonzero(at < len(self.keys))
        hit = hit[self.keys[at[hit]] == hashes[hit]]
        found = {}
        for i in hit.tolist():
            k = int(at[i])
            # Different rules may share a key: all of them stand next to each other.
            while k < len(self.keys) and self.keys[k] == hashes[i]:
                verdict, rule = self.text(k).split(" ", 1)
                if rule == wanted[i]:
                    found[i] = verdict, rule
                    break
                k += 1
        return found


@lru_cache(maxsize=4)
def _opened(path: str) -> DigestArray:
    return DigestArray(path)


def host_suffixes(host: str, labels: list[int]) -> list[str]:
    """Ends of the host of so many labels each, without the ones it is too short for."""
    most = labels[-1] if labels else 0
    last = host.rsplit(".", most)
    # What stands before the last ``most`` labels is one piece, whatever its length.
    count = len(last) if len(last) <= most else most
    return [host if k == len(last) else ".".join(last[-k:]) for k in labels if k <= count]


def judge(hosts: list[str], paths: list[str], arrays: list[DigestArray], default: str) -> tuple[list, list]:
    """Rule and verdict of every (host, path): the longest fitting rule, the longer host among equals."""
    best: list[tuple[int, int, str, str] | None] = [None] * len(hosts)
    for array in arrays:
        wanted, owner, host_size = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            for suffix in host_suffixes(host, array.labels):
                for size in array.lengths:
                    if size <= len(path):
                        wanted.append(suffix + path[:size])
                        owner.append(i)
                        host_size.append(len(suffix))
        for k, (verdict, rule) in array.find(wanted).items():
            rank = (len(rule), host_size[k], rule, verdict)
            if best[owner[k]] is None or rank[:2] > best[owner[k]][:2]:
                best[owner[k]] = rank
    return [b and b[2] for b in best], [b[3] if b else default for b in best]


def filter_urls(
    pages: DataFrame,
    rules: Iterable[Rule],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path, or null), verdict.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased; the path what follows up to ``?``, ``#`` or the end. A null url,
    or one without ``://``, has both empty. A rule fits its host and all subdomains
    of it, if the path starts with the rule's; the longest rule wins. Pages that no
    rule fits get ``default``. Repeated rows and null ids pass through; other
    columns are not read.
    """
    spark = ready(pages.sparkSession)
    names = pack_rules(spark, rules)
    parts = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    split = pages.select(
        F.col(id_col).alias("page_id"),
        F.regexp_extract(parts, r"(?s)^([^/?#]*)", 1).alias("host"),
        F.regexp_extract(parts, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    ).withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [_opened(SparkFiles.get(name)) for name in names]
        for batch in batches:
            found = judge(batch["host"].to_pylist(), batch["path"].to_pylist(), arrays, default)
            columns = [batch["page_id"], batch["host"], batch["path"], *(pa.array(x, pa.string()) for x in found)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

    kind = dict(split.dtypes)["page_id"]
    return split.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string")
