"""Slow, direct statements of the semantics, for checks on small inputs."""

from itertools import chain

MAIN = {"frequency": 1.0, "recent": 2.0, "recency": 1.5, "absence": 0.8, "repeat_penalty": 0.4}


def scores(newest_first, w=MAIN):
    """{number: score} of a list of number lists, newest first."""
    seen = sorted(set(chain.from_iterable(newest_first)))
    if not seen:
        return {}
    share = newest_first[: max(1, len(newest_first) * 3 // 10)]
    times = {n: sum(n in d for d in newest_first) for n in seen}
    lately = {n: sum(n in d for d in share) for n in seen}
    age = {n: next(i for i, d in enumerate(newest_first) if n in d) for n in seen}
    top, top_lately, oldest = max(times.values()), max(max(lately.values()), 1), max(max(age.values()), 1)
    out = {}
    for n in range(seen[0], seen[-1] + 1):
        value = times.get(n, 0) / top * w["frequency"] + lately.get(n, 0) / top_lately * w["recent"]
        gap = age[n] / oldest if n in age else None
        value += (0.0 if gap is None else 1 - gap) * w["recency"] + (1.0 if gap is None else gap) * w["absence"]
        value -= w["repeat_penalty"] if n in newest_first[0] else 0.0
        out[n] = max(value, 0.0)
    return out
