"""Mixing sources against a plain statement of the rule."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from brute_llm import spaced
from drawlake.llm.mix import emissions, mix_sources

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, number long, offset string"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, 7, "x") for i, s, t in rows], DOCS)


def targets(sizes, weights, most):
    """Exact targets: full sources leave what they can't take to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        unit = sum(weight[s] for s in order if s not in full)
        if not unit:
            return {s: Fraction(most * sizes[s]) for s in order}
        over = {s for s in order if s not in full and most * sizes[s] * unit <= left * weight[s]}
        if not over:
            return {s: Fraction(most * sizes[s]) if s in full else Fraction(left * weight[s], unit) for s in order}
        full |= over


def brute(rows, weights=(1, 2, 3), most=3, seed="mix"):
    docs, sizes = defaultdict(list), defaultdict(int)
    for i, s, t in rows:
        docs[s].append((len(spaced(t)), i is None, i or 0))
        sizes[s] += len(spaced(t))
    out, goal = [], targets(sizes, weights, most)
    for s, own in docs.items():
        rate = int(goal[s] / sizes[s] * 2**30) if sizes[s] else 0
        name = f"{seed}:" + ("n" if s is None else "s" + s)
        at = int(hashlib.md5(name.encode()).hexdigest()[:7], 16) * 4
        for size, missing, i in sorted(own):
            copies, at = ((at + rate) >> 30) - (at >> 30), at + rate
            out.append((None if missing else i, s, size, copies if size else 0))
    return sorted(out, key=str), goal


def random_docs(seed, count, sources):
    pick = random.Random(seed)
    rows = []
    for i in range(count):
        s = sources[0] if pick.random() < 0.4 else pick.choice(sources)
        text = pick.choice([None, "", " \t\n", "w " * pick.randrange(60), "a\tb\nc"])
        rows.append((i if pick.random() < 0.9 else pick.choice([None, 5]), s, text))
    return rows


@pytest.mark.parametrize("seed, sources", [(1, ["b", "a", None, "ä", "", "Z", "😀", "￿"]), (2, ["x"]), (3, ["p", "q"])])
def test_mix(spark, seed, sources):
    rows = random_docs(seed, 250, sources)
    want, goal = brute(rows)
    got = mix_sources(frame_of(spark, rows).repartition(7))
    taken = got.collect()
    assert sorted(((r.doc_id, r.source, r.size, r.copies) for r in taken), key=str) == want
    assert all(r.taken == r.size * r.copies <= 3 * r.size for r in taken)
    assert all(abs(r.target - float(goal[r.source])) <= 1e-9 * max(1, r.target) for r in taken)
    assert sum(r.copies for r in taken) == emissions(got).count()
    # Near: off by no more than the longest document of the source.
    for s in goal:
        mine = [r for r in taken if r.source == s]
        assert abs(sum(r.taken for r in mine) - goal[s]) <= max(r.size for r in mine) + 1


def test_mix_reruns_agree(spark):
    rows = random_docs(5, 120, ["a", "b", "c", None])
    runs = [
        sorted(map(str, mix_sources(frame_of(spark, order).repartition(parts)).collect()))
        for order, parts in ((rows, 1), (rows[::-1], 6))
    ]
    assert runs[0] == runs[1]


def test_mix_small_and_hot(spark):
    assert mix_sources(frame_of(spark, [])).collect() == []
    empty = mix_sources(frame_of(spark, [(1, "a", None), (2, None, "")])).collect()
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in empty} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    # One small source of great weight fills up at three times its size; the rest goes to the other one.
    full = mix_sources(frame_of(spark, [(k, "big", "w " * 10) for k in range(100)] + [(200, "small", "w " * 10)]), (1, 1000))
    assert {(r.source, r.target) for r in full.collect()} == {("big", 980.0), ("small", 30.0)}
    long = mix_sources(frame_of(spark, [(1, "a", "word " * 400_000), (2, "a", "w")]))
    assert sum(r.size for r in long.collect()) == 400_001
    copies = mix_sources(frame_of(spark, [(None, "a", "x y")] * 300 + [(3, "a", "x y")] * 300 + [(4, "b", "z " * 9)]))
    assert sum(r.taken for r in copies.collect() if r.source == "a") == pytest.approx(1209 - 27, abs=3)
