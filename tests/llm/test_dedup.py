"""Exact, line, substring and near deduplication against brute force."""

import random

import numpy as np
import pytest
from brute_llm import by_id, docs_frame, fingerprint, lined, near_components, removed_rows, removed_units, sha, spaced
from drawlake.llm import simhash
from drawlake.llm.common import powers, window_hashes, word_bounds, word_hashes
from drawlake.llm.exact_dedup import exact_duplicates
from drawlake.llm.graph import components
from drawlake.llm.line_dedup import remove_repeated_lines
from drawlake.llm.simhash import covering_masks, near_duplicates, near_links, second_masks
from drawlake.llm.substring_dedup import remove_repeated_windows


def random_texts(seed, count, units, joins, most):
    pick = random.Random(seed)
    passages = [[pick.choice(units) for _ in range(30)] for _ in range(4)]
    out = [None, "", " \t\n ", "x" * 70_000, ("long words " * 3000).strip()]
    while len(out) < count:
        words = [pick.choice(units) + str(pick.randrange(50)) for _ in range(pick.randrange(most))]
        if pick.random() < 0.5:
            cut = pick.randrange(len(words) + 1)
            words[cut:cut] = pick.choice(passages)
        text = "".join(w + pick.choice(joins) for w in words)
        out.append(text)
        if pick.random() < 0.3:
            out.append(text)
    pick.shuffle(out)
    return list(enumerate(out))


@pytest.fixture(scope="module")
def texts():
    return random_texts(3, 70, ["á", "b", "Cc", "日本", "e"], [" ", " ", "\t", "\n", "  "], 80)


def test_exact_groups(spark, texts):
    want = {}
    for i, t in texts:
        # The pattern parts at the ends as well, so a blank edge stays one space.
        import re

        want.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    rows = sorted((i, min(g), len(g), i == min(g), sha(t)) for t, g in want.items() for i in g)
    frame = docs_frame(spark, texts)
    columns = ("keep_id", "group_size", "kept", "text_sha256")
    assert by_id(exact_duplicates(frame), *columns) == rows
    # A crowded filter and one that is broadcast in a dozen ranges give the same.
    assert by_id(exact_duplicates(frame, bits_per_row=1), *columns) == rows
    ranged = exact_duplicates(frame, bits_per_row=12 * 32768 // len(texts), broadcast_bytes=4096)
    assert by_id(ranged, *columns) == rows


def test_exact_groups_of_many_rows_in_ranges(spark):
    pick = random.Random(8)
    rows = [(i, f"text {pick.randrange(6000) if i % 3 else -1}") for i in range(9000)]
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    frame = exact_duplicates(docs_frame(spark, rows).repartition(6), broadcast_bytes=2 * 4096)
    expected = sorted((i, min(g), len(g), i == min(g), sha(t)) for t, g in want.items() for i in g)
    assert by_id(frame, "keep_id", "group_size", "kept", "text_sha256") == expected
    # Rows with a digest of their own reach the result without a shuffle.
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and plan.count("Exchange hashpartitioning(digest") <= 2


def test_exact_repeated_and_missing_ids(spark):
    frame = docs_frame(spark, [(5, "a  b"), (5, "a b"), (None, "a b"), (None, "c"), (None, "c"), (1, None), (2, "")])
    rows = exact_duplicates(frame).collect()
    got = sorted(((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in rows), key=str)
    assert [g for g in got if g[1] == 5] == [("5", 5, 3, False), ("5", 5, 3, True), ("None", 5, 3, False)]
    assert [g for g in got if g[1] is None] == [("None", None, 2, False), ("None", None, 2, True)]
    assert ("1", 1, 2, True) in got and ("2", 1, 2, False) in got


def test_lines(spark):
    rows = random_texts(5, 60, ["l", "m"], ["\n"], 12) + [(900, "a\nb\nc\na\nb\nc\na\nb\nc"), (901, "\n\n\n\n")]
    want = removed_units(rows, lined, "\n", 3)
    got = remove_repeated_lines(docs_frame(spark, rows))
    assert by_id(got, "n_lines", "n_removed", "kept") == sorted((i, *x) for i, x in want.items())


def test_windows(spark, texts):
    rows = texts + [(900, "p " * 25), (901, "p " * 19), (902, " ".join(map(str, range(40))) + " " + " ".join(map(str, range(40))))]
    for width, inner in ((20, 6), (5, 2), (3, 3)):
        want = removed_units(rows, spaced, " ", width)
        got = remove_repeated_windows(docs_frame(spark, rows), width=width, inner=inner)
        assert by_id(got, "n_words", "n_removed", "kept") == sorted((i, *x) for i, x in want.items())


def test_window_intervals_are_maximal(spark):
    rows = [(1, "a b c d e f"), (2, "x a b c d y d e f z")]
    got = {r.doc_id: r.removed for r in remove_repeated_windows(docs_frame(spark, rows), width=3, inner=2).collect()}
    assert [tuple(s) for s in got[2]] == [(1, 5), (6, 9)] and got[1] == []


@pytest.mark.parametrize("operator", [remove_repeated_lines, remove_repeated_windows])
def test_rows_without_or_with_equal_ids(spark, operator):
    text = "\n".join(f"word{i}" for i in range(30))
    frame = docs_frame(spark, [(None, text), (None, text), (4, text), (4, text), (7, text)])
    got = sorted((str(r.doc_id), r.n_removed) for r in operator(frame).collect())
    assert got == [("4", 0), ("4", 30), ("7", 30), ("None", 0), ("None", 0)]


@pytest.mark.parametrize("operator", [exact_duplicates, remove_repeated_lines, remove_repeated_windows, near_duplicates])
def test_empty_table(spark, operator):
    assert operator(docs_frame(spark, [])).collect() == []


def test_word_hashes_follow_the_words():
    data = np.frombuffer(b"ab  cd\nab x cd", np.uint8)
    starts, ends, at = word_bounds(data, np.array([0, 7, 7, 14]))
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"cd", b"ab", b"x", b"cd"]
    assert at.tolist() == [0, 2, 2, 5]
    h = word_hashes(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    w = window_hashes(np.array([5, 6, 7, 5, 6], np.uint64), 2)
    assert w[0] == w[3] and len(set(w.tolist())) == 3
    assert powers(3, 5).tolist() == [1, 3, 9, 27, 81]


def test_masks_cover_every_pair_in_the_radius():
    pick = random.Random(1)
    families = [covering_masks(list(range(64)), 4)]
    families.append(second_masks(families[0][7], 4))
    for masks in families:
        for _ in range(3000):
            differing = sum(1 << b for b in pick.sample(range(64), pick.randint(1, 4)))
            if masks is families[1]:
                differing &= ~families[0][7]
            assert any(not m & differing for m in masks)
    # Inside a large bucket so few bits are free that a group is bounded.
    assert max(64 - m.bit_count() for first in families[0] for m in second_masks(first, 4)) <= 16


def test_fingerprints(texts):
    for _, t in texts:
        assert simhash.fingerprint(t or "") == fingerprint(t)


@pytest.mark.parametrize("bucket_rows", [2048, 2])
def test_links_connect_all_within_the_radius(spark, bucket_rows):
    pick = random.Random(2)
    prints = {}
    for base in range(12):
        centre = pick.getrandbits(64)
        for k in range(25):
            flips = sum(1 << b for b in pick.sample(range(64), pick.randint(0, 5)))
            prints[base * 100 + k] = centre ^ flips
    classes = {}
    for i, p in prints.items():
        classes[p] = min(i, classes.get(p, i))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for p, i in classes.items()], "fp long, rep long")
    roots = {r.node: r.root for r in components(near_links(frame, 4, bucket_rows)).collect()}
    want = near_components({i: p for p, i in classes.items()})
    assert {i: roots.get(i, i) for i in want} == want


def test_near_duplicates(spark, texts):
    rows = texts + [(500, None), (501, "Same Words here now and then"), (502, "same words here now  and then")]
    prints = {i: fingerprint(t) for i, t in rows}
    want = near_components(prints)
    got = near_duplicates(docs_frame(spark, rows))
    assert by_id(got, "fingerprint", "component_id") == sorted((i, f"{prints[i]:016x}", want[i]) for i in prints)


def test_near_duplicates_without_ids(spark):
    got = near_duplicates(docs_frame(spark, [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "q r s t u v w")]))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got.collect()) == [
        ("3", "3"), ("3", "3"), ("None", "3"), ("None", "None"),
    ]


def test_components_of_long_chains(spark):
    pick = random.Random(4)
    nodes = list(range(300))
    pick.shuffle(nodes)
    links = list(zip(nodes[:200], nodes[1:201])) + list(zip(nodes[201:], nodes[202:])) + [(nodes[0], nodes[0])]
    roots = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {n: min(g) for g in (nodes[:201], nodes[201:]) for n in g}
    assert {r.node: r.root for r in roots} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_that_share_ids(spark, seed):
    pick = random.Random(seed)
    lines, words = ["a", "b", "c", "d", "e"], [f"w{k}" for k in range(40)]
    passages = [[pick.choice(words) for _ in range(26)] for _ in range(3)]
    by_line, by_word = [], []
    for _ in range(40):
        by_line.append((pick.choice([None, 1, 1, 2, 3, 9]), "\n".join(pick.choice(lines) for _ in range(pick.randrange(9)))))
        body = [pick.choice(words) for _ in range(pick.randrange(12))] + pick.choice(passages)
        by_word.append((pick.choice([None, 1, 1, 2, 3, 9]), " ".join(body)))
    by_line += [(1, "a\nb\nc\nonlyA\ne"), (1, "x\na\nb\nc\ny"), (2, None), (2, "a\nb\nc"), (2, "a\nb\nc")]
    by_word += [by_word[0], by_word[0], (4, None), (4, None), (5, "")]
    want = removed_rows(by_line, lined, "\n", 3), removed_rows(by_word, spaced, " ", 20)
    for order in range(2):
        random.Random(order).shuffle(by_line)
        random.Random(order).shuffle(by_word)
        cut = remove_repeated_lines(docs_frame(spark, by_line).repartition(order + 2), carry=["doc_id", "lang", "n_chars"])
        rows = cut.collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in rows), key=str) == want[0]
        assert all(r.carried.doc_id == r.doc_id and r.carried.lang == "en" for r in rows)
        rows = remove_repeated_windows(docs_frame(spark, by_word).repartition(order + 2)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str) == want[1]


def test_line_found_once_stays(spark):
    rows = [(1, "a\nb\nc\nonlyA\ne"), (1, "x\na\nb\nc\ny")]
    kept = {r.kept for r in remove_repeated_lines(docs_frame(spark, rows)).collect()}
    assert any("onlyA" in k for k in kept) and sum("a\nb\nc" in k for k in kept) == 1
