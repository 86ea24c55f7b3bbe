"""Hard-negative mining with a forest of cover trees.

All rows are dealt out by label and nearest pivot, cut into blocks of bounded size,
and each block becomes a cover tree that is stored as one row. Anchors are sent to
the trees whose root bounds meet a window of theirs, a stated query set against all
rows; each tree is searched best first and its leaves are verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, saved
from .cover_tree import HIGHEST, LOWEST, MISSING, Tree, augmented, bounds, build, net, search, within
from .mix import numbered
from .vectors import is_finite, matrix, padded, scaled, widest

# Id of a row without one; such rows come last among equal scores.
NO_ID = (1 << 63) - 1
# Anchors a tree meets in one group; more are cut into slices, each with its own copy of the tree.
SLICE = 1 << 16
# Roots of trees that one routing group holds.
ROOTS = 1024
# Anchors handled at once, and rows of an emitted batch.
TOGETHER = 256
EMITTED = 4096

TREE = (
    "tree long, label long, width int, norm double, points binary, ids binary, rows binary, "
    "centre binary, radius binary, first binary, last binary, child binary, child_end binary, "
    "root array<long>, reach double"
)
NODES = ("centre", "radius", "first", "last", "child", "child_end")
HOME = "uid long, home long, vec_id long, label long, x array<long>, scores array<long>, ids array<long>"
ROUTED = "tree long, uid long, x array<long>, low array<long>, high array<long>"
FOUND = "uid long, slot int, score long, id long"


def _lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _ragged(column: pa.Array, fill: int) -> np.ndarray:
    """List column of whole numbers as a matrix, short rows filled up."""
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=0)), fill, np.int64)
    for k, values in enumerate(lists):
        out[k, : len(values)] = values
    return out


def pivots(rows: DataFrame, sample_rows: int, count: int) -> np.ndarray:
    """Net of at most ``count`` vectors of a sample of at most ``sample_rows`` rows, which the driver holds."""
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(sample_rows).select("x").toArrow()
    x = matrix(sample.column("x"))
    if not len(x):
        return x
    centres, _, _ = net(augmented(x)[0], np.arange(len(x)), 0, 0.0, count)
    return x[centres]


def _nearest(centres: np.ndarray):
    """Number of the pivot at the least distance."""
    half = (centres.astype(np.float64) ** 2).sum(1) / 2

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"))
            cell = (x.astype(np.float64) @ centres.astype(np.float64).T - half).argmax(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"]
            )

    return run


def _plant(tree_rows: int):
    """Trees of the rows of a task, which come sorted: a tree ends with its label or at ``tree_rows`` rows."""

    def planted(tree: int, parts: list) -> pa.RecordBatch:
        label = parts[0][0]
        ids, rows, x = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        made, order = build(x, ids)
        raw = [made.points, made.ids, rows[order], *(getattr(made, n) for n in NODES)]
        columns = [
            pa.array([tree]),
            pa.array([label]),
            pa.array([x.shape[1]], pa.int32()),
            pa.array([made.norm]),
            *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in raw],
            _lists(made.points[made.centre[:1]]),
            pa.array(made.radius[:1]),
        ]
        names = ["tree", "label", "width", "norm", "points", "ids", "rows", *NODES, "root", "reach"]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        from pyspark import TaskContext

        tree = TaskContext.get().partitionId() << 33
        parts, held = [], 0
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            ids = batch.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            x = matrix(batch.column("x"))
            at = 0
            while at < len(labels):
                same = np.flatnonzero(labels[at:] != labels[at])
                stop = min(at + (int(same[0]) if len(same) else len(labels) - at), at + tree_rows - held)
                if parts and (parts[0][0] != labels[at] or stop <= at):
                    yield planted(tree, parts)
                    tree, parts, held = tree + 1, [], 0
                    continue
                parts.append((int(labels[at]), ids[at:stop], rows[at:stop], x[at:stop]))
                held, at = held + stop - at, stop
        if parts:
            yield planted(tree, parts)

    return run


def _tree(batch: pa.RecordBatch, k: int) -> tuple[Tree, np.ndarray]:
    """Tree of a stored row, and the row numbers of its points."""

    def raw(name: str, kind=np.int64) -> np.ndarray:
        return np.frombuffer(batch.column(name)[k].as_py(), kind)

    width = batch.column("width")[k].as_py()
    ids = raw("ids")
    nodes = [raw(n, np.float64 if n == "radius" else np.int64) for n in NODES]
    return Tree(raw("points").reshape(len(ids), width), ids, batch.column("norm")[k].as_py(), *nodes), raw("rows")


def _at_home(every: int, positives: int):
    """Anchors of each tree with their best rows of the same tree, without themselves."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tree, rows = _tree(batch, k)
                anchors = np.flatnonzero((tree.ids % every == 0) & (tree.ids != NO_ID))
                for some in np.array_split(anchors, -(-len(anchors) // TOGETHER)) if len(anchors) else []:
                    ends = np.full((len(some), 1), LOWEST), np.full((len(some), 1), HIGHEST)
                    scores, ids = search(tree, tree.points[some], *ends, positives, some)
                    names = [f.split()[0] for f in HOME.split(", ")]
                    columns = [
                        pa.array(rows[some]),
                        pa.array(np.full(len(some), batch.column("tree")[k].as_py())),
                        pa.array(tree.ids[some]),
                        pa.array(np.full(len(some), batch.column("label")[k].as_py())),
                        _lists(tree.points[some]),
                        _lists(scores[:, 0]),
                        _lists(ids[:, 0]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _runs(batches):
    """Pieces (batch, start, stop) of equal ``kind``: 0 for stored rows, 1 for anchors."""
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(np.diff(kind)) + 1), len(kind)] if len(kind) else []
        for start, stop in zip([0, *ends], ends, strict=False):
            yield kind[start], batch.slice(start, stop - start)


def _route(same_label: bool):
    """Anchors of a group with each of the group's roots whose bounds meet one of their windows."""

    def run(batches):
        group, roots = None, []
        for kind, batch in _runs(batches):
            groups = batch.column("group").to_numpy(zero_copy_only=False)
            if kind == 0:
                for k in range(batch.num_rows):
                    if groups[k] != group:
                        group, roots = groups[k], []
                    roots.append([batch.column(n)[k].as_py() for n in ("tree", "label", "radius", "norm", "x")])
                continue
            # Anchors of a group without roots have nothing to meet.
            for own in np.unique(groups[groups == group]) if roots else []:
                yield from _routed(batch.filter(pa.array(groups == own)), roots, same_label)

    return run


def _routed(anchors: pa.RecordBatch, roots: list, same_label: bool):
    tree, label, radius, norm = (np.array([r[k] for r in roots]) for k in range(4))
    centres = np.array([r[4] for r in roots], np.int64)
    for start in range(0, anchors.num_rows, TOGETHER):
        some = anchors.slice(start, TOGETHER)
        x = matrix(some.column("x"))
        low, high = _ragged(some.column("low"), HIGHEST), _ragged(some.column("high"), LOWEST)
        least, most = bounds(x, centres, radius, norm)
        meets = within(least, most, low, high)
        alike = some.column("label").to_numpy(zero_copy_only=False)[:, None] == label
        meets &= alike if same_label else ~alike
        home = some.column("home").to_numpy(zero_copy_only=False)
        rows, which = np.nonzero(meets & (home[:, None] != tree))
        for at in range(0, len(rows), EMITTED):
            take = pa.array(rows[at : at + EMITTED])
            columns = [pa.array(tree[which[at : at + EMITTED]]), *[some.column(c).take(take) for c in ("uid", "x", "low", "high")]]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "uid", "x", "low", "high"])


def _searched(keep: int):
    """Best rows of a tree in each window of each anchor sent to it."""

    def run(batches):
        tree = None
        for kind, batch in _runs(batches):
            if kind == 0:
                # Trees follow each other only where a slice has no anchors; the last one counts.
                tree, _ = _tree(batch, batch.num_rows - 1)
                continue
            for start in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(start, TOGETHER)
                low, high = _ragged(some.column("low"), HIGHEST), _ragged(some.column("high"), LOWEST)
                scores, ids = search(tree, matrix(some.column("x")), low, high, keep)
                row, slot, place = np.nonzero(scores != MISSING)
                columns = [
                    some.column("uid").take(pa.array(row)),
                    pa.array(slot.astype(np.int32)),
                    pa.array(scores[row, slot, place]),
                    pa.array(ids[row, slot, place]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "slot", "score", "id"])

    return run


def _beside(stored: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables in one, dealt out by ``keys``; in each group the stored rows come before the anchors."""
    width = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = stored.withColumn("kind", F.lit(0)).unionByName(
        anchors.withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    return both.repartition(width, *keys).sortWithinPartitions(*keys, "kind")


def _meetings(forest: DataFrame, roots: DataFrame, root_groups: int, anchors: DataFrame, same_label: bool, keep: int):
    """Best rows of every tree that an anchor's windows meet: uid, slot, score, id.

    ``anchors`` has uid, home, label, x and the windows low and high.
    """
    everywhere = anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(root_groups - 1)).cast("array<bigint>")))
    spread = _beside(roots, everywhere, ["group"]).mapInArrow(_route(same_label), ROUTED)
    slices = max(1, -(-anchors.count() // SLICE))
    spread = spread.withColumn("slice", F.pmod(F.xxhash64("uid"), F.lit(slices)))
    copies = forest.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>")))
    return _beside(copies, spread, ["tree", "slice"]).mapInArrow(_searched(keep), FOUND)


def _first(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` rows per anchor and window, numbered by ``place``; most go before the shuffle."""
    order = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


def _share(score: str, percent: int, up: int) -> str:
    """SQL of score * percent / 100 in whole numbers, for scores from 0 on; ``up`` 99 rounds up, 0 down.

    No step leaves 64 bits.
    """
    return f"({percent} * (({score} - pmod({score}, 100)) DIV 100) + ({percent} * pmod({score}, 100) + {up}) DIV 100)"


def plant_forest(rows: DataFrame, tree_rows: int, sample_rows: int, pivot_count: int) -> DataFrame:
    """Cover trees of all ``rows`` (row, vec_id, label, x), one stored row each.

    Pivots only bring near rows together; every row is in exactly one tree. The row
    number parts rows that are alike, so a label or a vector that very many rows share
    spreads over tasks and trees.
    """
    dealt = rows.mapInArrow(
        _nearest(pivots(rows, sample_rows, pivot_count)), rows.withColumn("cell", F.lit(0)).schema
    )
    order = [F.col("label"), F.col("cell"), F.xxhash64("row"), F.col("row")]
    return saved(
        dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_plant(tree_rows), TREE), "forest"
    )


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    embeddings: DataFrame,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    factor: int = 256,
    tree_bytes: int = 1 << 20,
    sample_rows: int = 2048,
    pivot_count: int = 64,
    id_col: str = "vec_id",
    label_col: str = "label",
    vec_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without a label or with a null or non-finite component, or no vector, take no part.
    Components become floor(factor * x); missing ones at the end of a short vector are zero.
    Rows whose id is divisible by ``every`` are anchors. Of each, the ``positives`` other rows
    of its label with the largest inner product are positives, and for each of them the first
    ``negatives`` rows of other labels between ``least`` and ``most`` percent of its score come
    out, ranked from 1. Ties go to the smaller id; rows without an id come last and have a null
    id in the result. A row that repeats an id is a row of its own, as candidate and as anchor.
    Windows of negative scores are empty. Scores beyond 64 bits are cut to the largest ones.
    No usable row gives an empty result. The search is exact: pivots from at most
    ``sample_rows`` rows decide only which rows share a tree of at most ``tree_bytes``.
    """
    spark = ready(embeddings.sparkSession)
    picked = embeddings.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vec_col).alias("vec")
    ).filter(F.col("label").isNotNull() & is_finite(F.col("vec")))
    width = widest(picked, "vec")
    rows = saved(
        picked.select("vec_id", "label", padded(scaled(F.col("vec"), factor), width).alias("x")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "candidates",
    )
    if rows.isEmpty():
        return spark.createDataFrame([], OUT)
    tree_rows = max(64, tree_bytes // (8 * max(1, width)))
    forest = plant_forest(rows, tree_rows, sample_rows, pivot_count)
    roots = saved(
        numbered(forest.select("tree", "label", "norm", F.col("reach").alias("radius"), F.col("root").alias("x")), [F.col("tree")], "roots")
        .withColumn("group", F.expr(f"number DIV {ROOTS}"))
        .drop("number"),
        "root-groups",
    )
    groups = max(1, -(-roots.count() // ROOTS))
    anchors = saved(forest.mapInArrow(_at_home(every, positives), HOME), "anchors")

    worst = F.element_at("scores", positives)
    asks = anchors.select(
        "uid",
        "home",
        "label",
        "x",
        F.array(F.when(worst == MISSING, F.lit(LOWEST)).otherwise(worst)).alias("low"),
        F.array(F.lit(HIGHEST)).alias("high"),
    )
    at_home = anchors.select("uid", F.lit(0).alias("slot"), F.inline(F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("id"))))
    near = at_home.filter(F.col("score") != MISSING).unionByName(_meetings(forest, roots, groups, asks, True, positives))
    best = _first(near, positives).groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("positives")
    )
    # A negative score has no window: its upper end is below its lower one.
    low = F.expr(f"transform(positives, p -> {_share('greatest(p.score, 0L)', least, 99)})")
    high = F.expr(f"transform(positives, p -> IF(p.score < 0, -1L, {_share('greatest(p.score, 0L)', most, 0)}))")
    windows = saved(
        anchors.select("uid", "home", "label", "vec_id", "x")
        .join(best, "uid")
        .withColumns({"low": low, "high": high})
        .filter(F.exists("positives", lambda p: p["score"] >= 0)),
        "windows",
    )
    asked = windows.select("uid", "home", "label", "x", "low", "high")
    found = _first(_meetings(forest, roots, groups, asked, False, negatives), negatives)
    known = F.col("positives")[F.col("slot")]
    return found.join(windows.select("uid", "vec_id", "positives"), "uid").select(
        F.col("vec_id").alias("anchor_id"),
        F.nullif(known["id"], F.lit(NO_ID)).alias("positive_id"),
        F.col("place").alias("rank"),
        F.nullif(F.col("id"), F.lit(NO_ID)).alias("negative_id"),
        known["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
