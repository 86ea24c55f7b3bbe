"""Embedding whitening with a polarisation covariance.

Only squares are added up: of every centred dimension and of the sum of every
pair of dimensions. Var(a + b) - Var(a) - Var(b) is twice the covariance of a and
b, so differences of these variances give the whole matrix, which goes to eigh.
All sums are whole numbers and therefore exact in any order of rows and tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, saved
from .vectors import is_finite, matrix, padded, scaled, widest

SUMS = "i int, j int, total decimal(38,0)"
# Largest entry whose squared pair sums fit 64 bits over one batch (4,000 rows at most by the session's setting).
SMALL = 1 << 24
# A component counts as varying above this share of the largest eigenvalue.
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``rows`` distinct vectors with sums ``middle * rows + rest`` per dimension."""

    rows: int
    middle: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n without the rounding that a quotient of large sums would bring."""
        return (x - self.middle).astype(np.float64) - self.rest / self.rows

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of vectors; NaN for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self.centred(x) @ self.vectors / np.sqrt(self.values)
        return np.where(self.varying(), out, np.nan)

    def varying(self) -> np.ndarray:
        return self.values > LEAST_SHARE * max(self.values.max(initial=0.0), 0.0)


def _totals(blocks: list[np.ndarray]) -> list[int]:
    return [int(v) for block in blocks for v in block]


def _linear(batches):
    """Exact sums of each dimension over a task's rows, and the rows under -1."""
    total, rows = None, 0
    for batch in batches:
        x = matrix(batch.column("x"))
        if not len(x):
            continue
        # Parts of 32 bits cannot overflow over a batch.
        part = ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        total, rows = part if total is None else total + part, rows + len(x)
    if total is not None:
        places = range(-1, len(total))
        yield _sum_batch(places, places, [rows, *total])


def _sum_batch(i, j, totals) -> pa.RecordBatch:
    from decimal import Decimal

    columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(t)) for t in totals], pa.decimal128(38, 0))]
    return pa.RecordBatch.from_arrays(columns, ["i", "j", "total"])


def _squares(middle: np.ndarray):
    """Exact sums of squares of every centred dimension (i = j) and of every pair's sum (i < j)."""
    width = len(middle)

    def run(batches):
        total = None
        for batch in batches:
            x = matrix(batch.column("x"))
            if not len(x):
                continue
            c = x - middle
            if np.abs(c).max(initial=0) >= SMALL:
                c = c.astype(object)
            blocks = []
            for i in range(width):
                pair = c[:, i : i + 1] + c[:, i + 1 :]
                blocks.append((c[:, i] ** 2).sum(keepdims=True))
                blocks.append((pair * pair).sum(axis=0))
            part = np.concatenate(blocks).astype(object)
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(width)
            yield _sum_batch(i, j, total)

    return run


def _moments(model: Whitening):
    """Second moments of whitened components over a task's rows."""
    count = len(model.values)
    i, j = np.triu_indices(count)

    def run(batches):
        total, rows = np.zeros((count, count)), 0
        for batch in batches:
            w = model.project(matrix(batch.column("x")))
            total, rows = total + w.T @ w, rows + len(w)
        if rows:
            columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "total"])

    return run


def _added(sums: DataFrame) -> dict[tuple[int, int], int]:
    """Totals over all tasks. Tasks send one row per pair, which the shuffle adds; at most width^2 come here."""
    table = sums.groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()
    return {(i, j): v for i, j, v in zip(*(table.column(c).to_pylist() for c in ("i", "j", "total")), strict=True)}


def whole_vectors(rows: DataFrame, vec_col: str, factor: int, plus: int) -> DataFrame:
    """``rows`` with a finite vector, which becomes the whole numbers ``x`` of one length.

    Shorter vectors are filled up with the value of a zero component.
    """
    valid = rows.filter(is_finite(F.col(vec_col)))
    width = widest(valid, vec_col)
    return valid.withColumn("x", padded(scaled(F.col(vec_col), factor, plus), width, plus))


def fit_whitening(distinct: DataFrame, components: int) -> Whitening | None:
    """Fits on the vectors in ``x``; None where there are none.

    Integer means are taken off before squaring and the remainders of the means put
    back by exact arithmetic, which keeps the squares small at any count.
    """
    linear = _added(distinct.mapInArrow(_linear, SUMS))
    if not linear:
        return None
    n = int(linear.pop((-1, -1)))
    width = len(linear)
    sums = [int(linear[i, i]) for i in range(width)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    squares = _added(distinct.mapInArrow(_squares(np.array(middle, np.int64)), SUMS)) if width else {}
    # n^2 times the variance of a sum of dimensions, exact.
    alone = [n * int(squares[i, i]) - rest[i] ** 2 for i in range(width)]
    covariance = np.zeros((width, width))
    for (i, j), total in squares.items():
        both = alone[i] if i == j else n * int(total) - (rest[i] + rest[j]) ** 2
        value = both / (n * n) if i == j else (both - alone[i] - alone[j]) / (2 * n * n)
        covariance[i, j] = covariance[j, i] = value
    values, basis = np.linalg.eigh(covariance)
    falling = np.argsort(-values, kind="stable")[:components]
    basis = basis[:, falling]
    # Either sign is right; the largest entry is made positive so that reruns agree.
    if width:
        basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    return Whitening(
        n,
        np.array(middle, np.int64),
        np.array(rest, np.float64),
        basis,
        values[falling],
        sum(alone) / (n * n),
    )


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the fitted list's whitened covariance minus the identity, measured over all its rows."""
    kept = np.flatnonzero(model.varying())
    if not len(kept):
        return None
    reduced = Whitening(
        model.rows, model.middle, model.rest, model.vectors[:, kept], model.values[kept], model.trace
    )
    moments = _added(distinct.mapInArrow(_moments(reduced), "i int, j int, total double"))
    return max(abs(v / model.rows - (i == j)) for (i, j), v in moments.items())


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _deviations(model: Whitening, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; null beyond 63 bits."""
    c = x - model.middle
    rest = model.rest.astype(np.int64)
    most = model.rows * (int(np.abs(c).max(initial=0)) + 1)
    if most * most * max(1, x.shape[1]) < 1 << 63:
        return ((model.rows * c - rest) ** 2).sum(1).tolist()
    exact = ((model.rows * c.astype(object) - rest.astype(object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _whitened(model: Whitening, error: float | None):
    count = len(model.values)
    explained = (model.values / model.trace) if model.trace else np.full(count, np.nan)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"))
            rows = len(x)
            if not rows or not count:
                continue
            again = np.repeat(np.arange(rows), count)
            deviation = pa.array(_deviations(model, x), pa.int64())
            columns = [
                batch.column("vec_id").take(pa.array(again)),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * count, model.rows)),
                deviation.take(pa.array(again)),
                pa.array(model.project(x).ravel(), from_pandas=True),
                pa.array(np.tile(explained, rows), from_pandas=True),
                pa.array([error] * (rows * count), pa.float64()),
            ]
            names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def whiten(
    embeddings: DataFrame,
    components: int = 16,
    factor: int = 64,
    plus: int = 1_000_000,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row.

    Rows whose vector is null or holds a null, NaN or infinite component are left out;
    a shorter vector is filled up with zero components. The fit takes each distinct
    whole-number vector once. Components go by falling eigenvalue; of one without
    variance (equal vectors, one row, fewer vectors than dimensions) ``whitened`` is
    null, and with no variance at all ``explained`` and ``identity_error`` are null too.
    ``deviation`` is null beyond 63 bits. Repeated and missing ids keep a row each per
    component. No usable row, or only vectors without components, give an empty result.
    The driver sees sums of dimension pairs, never rows.
    """
    ready(embeddings.sparkSession)
    picked = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"))
    usable = whole_vectors(picked, "vec", factor, plus).select("vec_id", "x")
    schema = f"vec_id {embeddings.schema[id_col].dataType.simpleString()}, {OUT}"
    # Copies collapse before the shuffle, so a vector that a third of all rows share is no hot key.
    distinct = saved(usable.select("x").distinct(), "distinct-vectors")
    model = fit_whitening(distinct, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, model)
    return usable.mapInArrow(_whitened(model, error), schema)
