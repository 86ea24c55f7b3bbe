"""Cover trees for inner-product windows over blocks of whole-number vectors.

One more coordinate, sqrt(M^2 - |x|^2), gives all vectors of a tree the norm M.
Then closeness and inner product order alike, and a node whose points lie within
a radius of its centre bounds the inner products of all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 64
# The covering radius falls by this factor from level to level.
BASE = 1.25
# Scores are held in 64 bits; larger ones are cut to these ends.
LOWEST, HIGHEST = -(1 << 63) + 1, (1 << 63) - 1
MISSING = -(1 << 63)
# Leaves that a round verifies for a query at most, and by how much rounds grow.
MOST_A_ROUND = 64
GROWTH = 8
# Points multiplied at once, and scores held before they are reduced to the best of each window.
BLOCK = 4096
HELD = 1 << 20


@dataclass(frozen=True)
class Tree:
    """Points in leaf order; nodes in breadth-first order, children and points of a node side by side."""

    points: np.ndarray
    ids: np.ndarray
    norm: float
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray
    child_end: np.ndarray


def augmented(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Points with the coordinate that gives all the largest norm, and this norm."""
    flat = points.astype(np.float64)
    squares = np.einsum("ij,ij->i", flat, flat)
    most = squares.max(initial=0.0)
    return np.column_stack([flat, np.sqrt(most - squares)]), float(np.sqrt(most))


def _away(lifted: np.ndarray, rows: np.ndarray, centre: int) -> np.ndarray:
    gap = lifted[rows] - lifted[centre]
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def net(
    lifted: np.ndarray, rows: np.ndarray, centre: int, radius: float, most: int
) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres more than ``radius`` apart that cover ``rows`` within it, the nearest one of each row, and its distance.

    The first centre is given; the row farthest from all centres is the next. After
    ``most`` centres the net stays coarser: in spread-out data no radius parts the
    points into groups, and the distances returned tell how far each centre reaches.
    """
    centres, nearest = [centre], np.zeros(len(rows), np.int64)
    distance = _away(lifted, rows, centre)
    while distance.max() > radius and len(centres) < most:
        far = int(rows[distance.argmax()])
        to_far = _away(lifted, rows, far)
        closer = to_far < distance
        nearest[closer] = len(centres)
        distance[closer] = to_far[closer]
        centres.append(far)
    return centres, nearest, distance


def build(points: np.ndarray, ids: np.ndarray) -> tuple[Tree, np.ndarray]:
    """Cover tree of a block of points, and the old place of each of its points.

    Level by level the covering radius falls; a node's children are a net of its
    points at the next radius below its own. Nodes of few points, or of equal ones,
    are leaves.
    """
    lifted, norm = augmented(points)
    order = np.arange(len(points))
    middle = lifted.mean(0)
    start = int(np.einsum("ij,ij->i", lifted - middle, lifted - middle).argmin())
    top = float(_away(lifted, order, start).max())
    centre, radius, first, last, child, child_end = [start], [top], [0], [len(points)], [0], [0]
    at = 0
    while at < len(centre):
        a, b = first[at], last[at]
        if b - a > LEAF and radius[at] > 0:
            level = np.ceil(np.log(top / radius[at]) / np.log(BASE) + 1e-9)
            within = min(top / BASE**level, radius[at] / 1.000001)
            own = order[a:b]
            centres, nearest, distance = net(lifted, own, centre[at], within, max(2, len(own) // LEAF))
            sort = np.argsort(nearest, kind="stable")
            order[a:b] = own[sort]
            ends = a + np.cumsum(np.bincount(nearest, minlength=len(centres)))
            reach = np.zeros(len(centres))
            np.maximum.at(reach, nearest, distance)
            child[at] = len(centre)
            for c, r, begin, end in zip(centres, reach, [a, *ends[:-1]], ends, strict=True):
                centre.append(c)
                radius.append(float(r))
                first.append(int(begin))
                last.append(int(end))
                child.append(0)
                child_end.append(0)
            child_end[at] = len(centre)
        at += 1
    # Points of a leaf by id, so that a stable sort by score breaks ties.
    leaf_of = np.zeros(len(points), np.int64)
    for node in np.flatnonzero(np.array(child_end) == 0):
        leaf_of[first[node] : last[node]] = first[node]
    order = order[np.lexsort((ids[order], leaf_of))]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    tree = Tree(
        points[order],
        ids[order],
        norm,
        place[np.array(centre)],
        np.array(radius),
        *(np.array(v, np.int64) for v in (first, last, child, child_end)),
    )
    return tree, order


def exact_kind(most: float):
    """Fastest type in which inner products of whole-number rows up to ``most`` are exact, and the end of its range."""
    if most < 1 << 53:
        return (np.float32, 1 << 24) if most < 1 << 24 else (np.float64, 1 << 53)
    return object, HIGHEST


def bounds(queries: np.ndarray, centres: np.ndarray, radius: np.ndarray, norm) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each query with any point within ``radius`` of each centre.

    The ball and the cap that it cuts out of the sphere of radius ``norm`` both bound; the closer
    bound holds. Rounding is covered by a margin, and bounds are cut where scores are.
    """
    q, c = queries.astype(np.float64), centres.astype(np.float64)
    straight = q @ c.T
    length = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
    norm = np.broadcast_to(np.asarray(norm, np.float64), radius.shape)
    scale = length * norm
    angle = np.arccos(np.clip(straight / np.maximum(scale, 1e-300), -1, 1))
    spread = 2 * np.arcsin(np.minimum(1.0, radius / np.maximum(2 * norm, 1e-300)))
    margin = 1e-6 * (1 + scale)
    high = np.minimum(straight + length * radius, scale * np.cos(np.maximum(0.0, angle - spread)))
    low = np.maximum(straight - length * radius, scale * np.cos(np.minimum(np.pi, angle + spread)))
    return np.minimum(low - margin, float(HIGHEST)), np.maximum(high + margin, float(LOWEST))


def within(least, most, low, high) -> np.ndarray:
    """Whether a node may hold a point of any of the query's windows."""
    fits = np.zeros(least.shape, bool)
    for w in range(low.shape[1]):
        open_ = low[:, w : w + 1] <= high[:, w : w + 1]
        fits |= open_ & (most >= low[:, w : w + 1]) & (least <= high[:, w : w + 1])
    return fits


def _best(scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``keep`` of the last axis by falling score, then id; ~score cannot overflow."""
    sort = np.lexsort((ids, ~scores), axis=-1)[..., :keep]
    return np.take_along_axis(scores, sort, -1), np.take_along_axis(ids, sort, -1)


def search(tree: Tree, queries: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int, skip: np.ndarray | None = None):
    """The ``keep`` points of largest score in each window [low, high] of each query: scores and ids.

    ``low`` and ``high`` have a column per window. Nodes outside all windows of a query
    are left with all below them. The remaining leaves are verified by exact products,
    those of the largest bound first, ``GROWTH`` times as many each round, until no bound
    reaches the worst score kept. ``skip`` names a point each query does not want, or -1.
    Scores that are missing are MISSING.
    """
    count, windows = low.shape
    best = np.full((count, windows, keep), MISSING, np.int64), np.zeros((count, windows, keep), np.int64)
    least, most = bounds(queries, tree.points[tree.centre], tree.radius, tree.norm)
    alive = within(least, most, low, high)
    for node in np.flatnonzero(tree.child_end):
        alive[:, tree.child[node] : tree.child_end[node]] &= alive[:, node : node + 1]
    leaves = np.flatnonzero(tree.child_end == 0)
    reach, floor = np.where(alive[:, leaves], most[:, leaves], -np.inf), least[:, leaves]
    turn = np.argsort(-reach, axis=1, kind="stable")
    longest = float(np.sqrt((queries.astype(np.float64) ** 2).sum(1).max(initial=0.0)))
    # The margin covers the rounding of both lengths.
    kind, end = exact_kind(longest * tree.norm * (1 + 1e-9))
    left, right = queries.astype(kind), tree.points.astype(kind)
    done, step = 0, 1
    while done < len(leaves):
        chosen = turn[:, done : done + step]
        bound = np.take_along_axis(reach, chosen, 1)
        worst = np.maximum(best[0][:, :, -1], low)
        useful = np.isfinite(bound) & within(np.take_along_axis(floor, chosen, 1), bound, worst, high)
        # Later leaves reach no further than the first of this round.
        if not (np.isfinite(bound[:, 0]) & (bound[:, :1] >= worst).any(1)).any():
            break
        # A score below the worst of all open windows, or above all of them, is in none.
        open_ = worst <= high
        ends = np.where(open_, worst, HIGHEST).min(1), np.where(open_, high, LOWEST).max(1)
        ends = [np.clip(e, -end, end).astype(kind if end < HIGHEST else np.int64)[:, None] for e in ends]
        rows, slots = np.nonzero(useful)
        named = chosen[rows, slots]
        sort = np.argsort(named, kind="stable")
        cuts = np.flatnonzero(np.diff(named[sort])) + 1
        parts, held = [], 0
        for part in np.split(sort, cuts) if len(sort) else []:
            asked = rows[part]
            own, lows, highs = left[asked], ends[0][asked], ends[1][asked]
            for a, b in _blocks(tree, leaves[named[part[0]]], keep):
                got = own @ right[a:b].T
                if kind is object:
                    got = np.clip(got, LOWEST, HIGHEST).astype(np.int64)
                row, point = np.nonzero((got >= lows) & (got <= highs))
                parts.append((asked[row], got[row, point].astype(np.int64), point + a))
                held += len(row)
                if held > HELD:
                    best, parts, held = _reduced(best, parts, tree.ids, low, high, skip), [], 0
        best = _reduced(best, parts, tree.ids, low, high, skip)
        done, step = done + step, min(GROWTH * step, MOST_A_ROUND)
    return best


def _blocks(tree: Tree, node: int, keep: int) -> list[tuple[int, int]]:
    """Ranges of a leaf's points; of equal points only the first by id can be kept, and one that is skipped."""
    a, b = int(tree.first[node]), int(tree.last[node])
    if tree.radius[node] == 0 and b - a > keep + 1 and (tree.points[a:b] == tree.points[a]).all():
        b = a + keep + 1
    return [(at, min(at + BLOCK, b)) for at in range(a, b, BLOCK)]


def _reduced(best, parts: list, ids: np.ndarray, low: np.ndarray, high: np.ndarray, skip: np.ndarray | None):
    """``best`` with scores (query, score, point) of more points: the first of each window by falling score, then id."""
    if not parts:
        return best
    query, score, point = (np.concatenate([p[k] for p in parts]) for k in range(3))
    if skip is not None:
        wanted = point != skip[query]
        query, score, point = query[wanted], score[wanted], point[wanted]
    if not len(query):
        return best
    name = ids[point]
    sort = np.lexsort((name, ~score, query))
    query, score, name = query[sort], score[sort], name[sort]
    count, windows = low.shape
    keep = best[0].shape[-1]
    until = np.cumsum(np.bincount(query, minlength=count))
    start = until - np.bincount(query, minlength=count)
    more = np.full((count, windows, keep), MISSING, np.int64), np.zeros((count, windows, keep), np.int64)
    for w in range(windows):
        above = np.bincount(query[score > high[query, w]], minlength=count)
        at = (start + above)[:, None] + np.arange(keep)
        inside = np.minimum(at, len(score) - 1)
        fits = (at < until[:, None]) & (score[inside] >= low[:, w : w + 1])
        more[0][:, w][fits], more[1][:, w][fits] = score[inside][fits], name[inside][fits]
    return _best(*(np.concatenate(both, -1) for both in zip(best, more, strict=True)), keep)
