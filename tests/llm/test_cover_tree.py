"""Cover trees: invariants, and window searches against all products."""

import numpy as np
import pytest
from drawlake.llm import cover_tree
from drawlake.llm.cover_tree import HIGHEST, LOWEST, MISSING, augmented, build, search


@pytest.mark.parametrize("count, width, scale", [(1, 3, 4), (70, 3, 4), (900, 4, 6), (1500, 64, 30), (3000, 2, 5), (500, 8, 2**30)])
def test_windows(count, width, scale):
    draw = np.random.default_rng(count)
    points = (draw.normal(size=(count, width)) * scale).astype(np.int64)
    points[count // 2 : count // 2 + count // 4] = points[0]
    ids = draw.integers(0, 2 * count, count)
    tree, order = build(points, ids)
    assert (tree.points == points[order]).all() and (tree.ids == ids[order]).all()
    lifted, _ = augmented(tree.points)
    for node in range(len(tree.centre)):
        gap = lifted[tree.first[node] : tree.last[node]] - lifted[tree.centre[node]]
        assert np.sqrt((gap**2).sum(1)).max() <= tree.radius[node] * (1 + 1e-7) + 1e-6
        if tree.child_end[node]:
            below = range(tree.child[node], tree.child_end[node])
            assert [tree.first[node], *(tree.last[c] for c in below)] == [*(tree.first[c] for c in below), tree.last[node]]
    queries = np.vstack([points[draw.integers(0, count, 15)], (draw.normal(size=(15, width)) * scale).astype(np.int64)])
    scores = np.clip(queries.astype(object) @ tree.points.T.astype(object), LOWEST, HIGHEST).astype(np.int64)
    ends = np.sort(np.array([[draw.choice(row, 2) for _ in range(3)] for row in scores]), -1)
    low, high = ends[..., 0], ends[..., 1]
    low[0, 0], high[0, 0] = LOWEST, HIGHEST
    low[1, 1], high[1, 1] = 5, 4
    skip = np.where(np.arange(30) % 3 == 0, draw.integers(0, count, 30), -1)
    found, names = search(tree, queries, low, high, 4, skip)
    for q in range(30):
        for w in range(3):
            inside = [k for k in range(count) if k != skip[q] and low[q, w] <= scores[q][k] <= high[q, w]]
            want = sorted((-int(scores[q][k]), int(tree.ids[k])) for k in inside)[:4]
            got = [(-int(s), int(i)) for s, i in zip(found[q, w], names[q, w], strict=True) if s != MISSING]
            assert got == want


def test_a_search_takes_few_rounds_and_holds_few_scores(monkeypatch):
    draw = np.random.default_rng(5)
    points = (draw.normal(size=(3000, 16)) * 50).astype(np.int64)
    points[1000:1700] = points[0]
    tree, _ = build(points, draw.integers(0, 4000, 3000))
    leaves = int((tree.child_end == 0).sum())
    assert leaves > 40
    queries = points[::100]
    low, high = np.full((30, 2), LOWEST), np.full((30, 2), HIGHEST)
    high[:, 1] = 20_000
    rounds, within = [], cover_tree.within
    monkeypatch.setattr(cover_tree, "within", lambda *a: rounds.append(1) or within(*a))
    scores, ids = search(tree, queries, low, high, 5, np.arange(30))
    # One call is for the nodes; rounds of 1 and 8 leaves come before those of 64.
    assert len(rounds) <= 3 + -(-(leaves - 9) // cover_tree.MOST_A_ROUND)
    # Of equal points a leaf brings no more than a query can keep.
    whole = np.flatnonzero((tree.child_end == 0) & (tree.radius == 0) & (tree.last - tree.first > 100))
    assert len(whole) and all(sum(b - a for a, b in cover_tree._blocks(tree, n, 5)) == 6 for n in whole)
    got = queries @ tree.points.T
    for q in range(30):
        for w in range(2):
            want = sorted((-int(s), int(i)) for k, (s, i) in enumerate(zip(got[q], tree.ids)) if k != q and s <= high[q, w])[:5]
            assert [(-int(s), int(i)) for s, i in zip(scores[q, w], ids[q, w])] == want
    # Scores that are reduced early, block by block, come out the same.
    monkeypatch.setattr(cover_tree, "HELD", 20)
    monkeypatch.setattr(cover_tree, "BLOCK", 7)
    again = search(tree, queries, low, high, 5, np.arange(30))
    assert (again[0] == scores).all() and (again[1] == ids).all()
