"""Tables that micro-batches append to for years: open batches, merged segments, a manifest.

A batch writes its own small folder with overwrite, so a repeated batch replaces
itself. Every ``MERGE_EVERY`` batches the complete ones become one segment, and that
many segments of a level become one of the next, so a table of n batches consists of
a few dozen folders, whatever n. The manifest names the segments, the batches each
covers and the range of keys of each pool; it is replaced by a rename. A folder it
does not name, or whose batches a segment covers, is left over from a failure and not
read. So a merge that fails is repeated and a reader sees either state, never both.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MERGE_EVERY = 32


@dataclass(frozen=True)
class Segment:
    """Folder of the batches ``first`` to ``last``; ``ranges`` has the smallest and largest key of each pool."""

    folder: str
    first: int
    last: int
    level: int
    ranges: dict[str, list[int]] = field(default_factory=dict)

    def may_hold(self, wanted: dict[str, tuple[int, int]] | None) -> bool:
        if wanted is None or not self.ranges:
            return True
        return any(k in self.ranges and self.ranges[k][0] <= high and low <= self.ranges[k][1] for k, (low, high) in wanted.items())


class SegmentedTable:
    """``key`` names the column whose ranges the manifest keeps; ``combine`` may condense rows while they are merged."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType,
        key: str = "draw_no",
        combine: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> None:
        self.spark, self.root, self.schema, self.key, self.combine = spark, root.rstrip("/"), schema, key, combine
        self._jvm = spark.sparkContext._jvm
        top = self._path(self.root)
        self._files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self._files.listStatus(path)] if self._files.exists(path) else []

    def segments(self) -> list[Segment]:
        """Segments of the newest manifest."""
        versions = [n for n in self._names("manifest") if n.endswith(".json")]
        if not versions:
            return []
        text = self.spark.read.text(f"{self.root}/manifest/{max(versions)}", wholetext=True).first()[0]
        return [Segment(**s) for s in json.loads(text)]

    def open_batches(self, merged: int) -> list[int]:
        """Complete batches that no segment covers."""
        found = [int(n) for n in self._names("open") if n.isdigit() and int(n) > merged]
        return sorted(b for b in found if self._files.exists(self._path(f"{self._open(b)}/_SUCCESS")))

    def _open(self, batch_id: int) -> str:
        return f"{self.root}/open/{batch_id:012d}"

    def merged_upto(self, segments: list[Segment] | None = None) -> int:
        return max((s.last for s in (self.segments() if segments is None else segments)), default=-1)

    def write(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Writes a batch and returns it as written. One that a segment covers is final and stays."""
        if batch_id > self.merged_upto():
            rows.write.mode("overwrite").parquet(self._open(batch_id))
            return self._read([self._open(batch_id)])
        return self._read([])

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, before: int | None = None, wanted: dict[str, tuple[int, int]] | None = None) -> DataFrame:
        """Rows of all batches, or of those before one; with ``wanted`` only of segments that may hold such keys."""
        segments = self.segments()
        folders = [s.folder for s in segments if (before is None or s.last < before) and s.may_hold(wanted)]
        opened = self.open_batches(self.merged_upto(segments))
        return self._read(folders + [self._open(b) for b in opened if before is None or b < before])

    def merge(self, before: int) -> None:
        """Merges the batches before ``before`` once there are enough, then segments of equal level likewise."""
        segments = self.segments()
        done = [b for b in self.open_batches(self.merged_upto(segments)) if b < before]
        if len(done) < MERGE_EVERY:
            return
        self._clean(segments)
        level, covered = 0, [Segment(self._open(b), b, b, -1) for b in done]
        while True:
            made = self._merged(covered, level)
            gone = {s.folder for s in covered}
            segments = [s for s in segments if s.folder not in gone] + [made]
            self._commit(segments)
            covered = [s for s in segments if s.level == level]
            if len(covered) < MERGE_EVERY:
                return
            level += 1

    def _clean(self, segments: list[Segment]) -> None:
        """Deletes what earlier merges left: by now no reader can be at it."""
        named, upto = {s.folder.rsplit("/", 1)[1] for s in segments}, self.merged_upto(segments)
        gone = [f"open/{n}" for n in self._names("open") if n.isdigit() and int(n) <= upto]
        gone += [f"merged/{n}" for n in self._names("merged") if n not in named]
        for name in gone:
            self._files.delete(self._path(f"{self.root}/{name}"), True)

    def _merged(self, covered: list[Segment], level: int) -> Segment:
        first, last = min(s.first for s in covered), max(s.last for s in covered)
        folder = f"{self.root}/merged/{level}-{first:012d}-{last:012d}"
        rows = self.combine(self._read([s.folder for s in covered]))
        keys = ["lottery_type", self.key]
        # Row groups that are ordered by key let readers skip most of a segment.
        placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        placed.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(folder)
        ends = self._read([folder]).groupBy("lottery_type").agg(F.min(self.key), F.max(self.key)).collect()
        ranges = {kind: [low, high] for kind, low, high in ends if kind is not None and low is not None}
        # Rows without a pool or key are in no range: such a segment is always read.
        return Segment(folder, first, last, level, ranges if len(ranges) == len(ends) else {})

    def _commit(self, segments: list[Segment]) -> None:
        versions = sorted(n for n in self._names("manifest") if n.endswith(".json"))
        number = int(versions[-1].split(".")[0]) + 1 if versions else 0
        draft, final = (self._path(f"{self.root}/manifest/{name}") for name in ("draft", f"{number:012d}.json"))
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps([asdict(s) for s in segments]).encode()))
        out.close()
        if not self._files.rename(draft, final):
            raise OSError(f"the manifest {final} could not be written")
        for old in versions[:-1]:
            self._files.delete(self._path(f"{self.root}/manifest/{old}"), False)
