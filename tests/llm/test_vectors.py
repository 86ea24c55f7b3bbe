"""Whitening and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from drawlake.llm.whiten import whiten

VECS = "vec_id long, embedding array<float>, label int, x array<long>, score string"
BAD = [None, [1.0, None], [float("nan"), 0.0], [float("inf")], [float("-inf"), 1.0]]


def frame_of(spark, rows):
    """Embeddings with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, label, None, "s") for i, v, label in rows], VECS)


def random_vectors(seed, count, width=5):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    out = []
    for i in range(count):
        vector = [float(np.float32(c + pick.gauss(0, 0.3))) for c in pick.choice(centres)]
        out.append((i, out[-1][1] if out and pick.random() < 0.2 else vector, pick.randrange(3)))
    return out


def whitened_brute(rows, components=16):
    """Covariances entry by entry over the distinct whole vectors, in exact arithmetic until the division."""
    usable = [
        (i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    width = max((len(v) for _, v in usable), default=0)
    whole = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))])) for i, v in usable]
    fit = sorted({x for _, x in whole})
    n = len(fit)
    sums = [sum(x[k] for x in fit) for k in range(width)]
    cov = np.array(
        [[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit) / n**3 for b in range(width)] for a in range(width)]
    ).reshape(width, width)
    values, basis = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    out = {}
    for i, x in whole:
        centred = np.array([(n * x[k] - sums[k]) / n for k in range(width)])
        deviation = sum((n * x[k] - sums[k]) ** 2 for k in range(width))
        out.setdefault(i, []).append((deviation, centred @ basis[:, order] / np.sqrt(values[order])))
    return n, values[order] / values.sum(), out


@pytest.mark.parametrize("count", [60, 300])
def test_whitening(spark, count):
    rows = random_vectors(count, count) + [(1000 + k, v, 1) for k, v in enumerate(BAD)]
    rows += [(None, rows[3][1], 0), (7, rows[9][1], None)]
    random.Random(1).shuffle(rows)
    n, explained, want = whitened_brute(rows)
    got = {}
    for r in whiten(frame_of(spark, rows).repartition(5)).collect():
        assert r.n == n and r.identity_error < 1e-9
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        got.setdefault(r.vec_id, []).append((r.component, r.deviation, r.whitened))
    assert sorted(got, key=str) == sorted(want, key=str)
    signs = None
    for i, expected in want.items():
        mine = sorted(got[i])
        assert sorted(d for _, d, _ in mine) == sorted(d for d, _ in expected for _ in explained)
        if len(expected) == 1:
            values = np.array([w for _, _, w in mine])
            if signs is None and np.abs(values).min() > 1e-3:
                signs = np.sign(values * expected[0][1])
            if signs is not None:
                assert np.allclose(values, signs * expected[0][1], atol=1e-9)
    assert signs is not None


def test_whitening_degenerate(spark):
    assert whiten(frame_of(spark, [])).collect() == []
    assert whiten(frame_of(spark, [(1, None, 1)])).collect() == []
    assert whiten(frame_of(spark, [(1, [], 1), (2, [], 1)])).collect() == []
    alike = whiten(frame_of(spark, [(1, [0.5, 2.0], 1), (2, [0.5, 2.0], 1)])).collect()
    assert sorted((r.vec_id, r.component) for r in alike) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in alike)
    # Two points vary along one line only; the short vector ends in zero components.
    line = whiten(frame_of(spark, [(1, [0.0, 1.0], 1), (2, [0.0], 1)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}
    assert sorted(round(r.whitened, 9) for r in line if r.component == 1) == [-1.0, 1.0]


def test_whitening_large_entries(spark):
    rows = [(i, [float(np.float32(1e9 * (i % 7))), float(np.float32(i - 3e8 * (i % 5)))], 0) for i in range(40)]
    n, explained, want = whitened_brute(rows)
    got = whiten(frame_of(spark, rows)).collect()
    assert {(r.vec_id, r.deviation) for r in got} == {(i, d if d < 2**63 else None) for i, rs in want.items() for d, _ in rs}
    assert all(math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-6) for r in got)


def mined_brute(rows, every=50, positives=5, negatives=3):
    """All scores of every anchor, sorted."""
    usable = [(i, v, label) for i, v, label in rows if v is not None and label is not None]
    usable = [u for u in usable if all(c is not None and math.isfinite(c) for c in u[1])]
    width = max((len(v) for _, v, _ in usable), default=0)
    whole = [(i, [math.floor(256 * c) for c in v] + [0] * (width - len(v)), label) for i, v, label in usable]
    out = []
    for a, (anchor, x, label) in enumerate(whole):
        if anchor is None or anchor % every:
            continue
        scored = sorted(
            (-sum(p * q for p, q in zip(x, y, strict=True)), i is None, i or 0, other)
            for b, (i, y, other) in enumerate(whole)
            if a != b
        )
        for p in [s for s in scored if s[3] == label][:positives]:
            inside = [s for s in scored if s[3] != label and -50 * p[0] <= -100 * s[0] <= -95 * p[0]]
            for rank, n in enumerate(inside[:negatives], 1):
                out.append((anchor, None if p[1] else p[2], rank, None if n[1] else n[2], -p[0], -n[0]))
    return sorted(out, key=str)


MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(frame):
    return sorted((tuple(r[c] for c in MINED) for r in frame.collect()), key=str)


@pytest.mark.parametrize("width, tree_bytes", [(3, 1 << 20), (8, 1)])
def test_hard_negatives(spark, monkeypatch, width, tree_bytes):
    from drawlake.llm import negatives

    monkeypatch.setattr(negatives, "ROOTS", 2)
    monkeypatch.setattr(negatives, "SLICE", 3)
    rows = [(i % 400, v, label) for i, v, label in random_vectors(width, 500, width)]
    # Repeated and missing ids, ties by equal vectors, one vector of very many rows, useless rows, a short vector.
    rows += [(None, rows[50][1], 1), (None, rows[50][1], 1), (50, rows[0][1], 1), (50, rows[0][1], 1)]
    rows += [(k, rows[0][1], k % 3) for k in range(1000, 1150)]
    rows += [(2000 + k, v, 1) for k, v in enumerate(BAD)] + [(2050, rows[3][1], None), (2100, rows[3][1][:-1], 2)]
    random.Random(2).shuffle(rows)
    want = mined_brute(rows)
    assert len(want) > 100
    assert mined(negatives.hard_negatives(frame_of(spark, rows).repartition(4), tree_bytes=tree_bytes)) == want


def test_hard_negatives_small(spark):
    from drawlake.llm.negatives import hard_negatives

    for rows in (
        [],
        [(50, None, 1), (100, [1.0], None)],
        [(50, [1.0, 2.0], 1)],
        [(50, [1.0], 1), (1, [1.0], 1)],
        [(50, [], 1), (1, [], 1), (2, [], 2)],
        [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2), (3, [5.0], 2)],
        [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.7], 2)],
        [(0, [2.0**40, 1.0], 1), (1, [2.0**3, 1.0], 1), (2, [2.0**2, 3.0], 2), (3, [2.0**2.5, 3.0], 2)],
    ):
        assert mined(hard_negatives(frame_of(spark, rows))) == mined_brute(rows)
    # Beyond 64 bits scores are cut, and nothing fails.
    assert mined(hard_negatives(frame_of(spark, [(0, [1e18], 1), (1, [1e18], 1), (2, [1e18], 2)]))) == []
