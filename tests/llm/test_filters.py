"""Decontamination, url rules and chats against brute force."""

import random

import pytest
from brute_llm import by_id, docs_frame, leak_rows
from drawlake.llm import url_filter
from drawlake.llm.chat import format_chats
from drawlake.llm.decontaminate import decontaminate
from drawlake.llm.queries import URL_RULES
from drawlake.llm.url_filter import filter_urls


@pytest.fixture(scope="module")
def leaks():
    pick = random.Random(8)
    words = ["The", "of", "École", "straße", "İx", "ΑΣ", "a1", "日本", "K", "rare", "x"]
    items = [(k, " ".join(pick.choice(words) + pick.choice(["", "", "2"]) for _ in range(pick.randrange(25)))) for k in range(30)]
    items += [(30, None), (31, "!!"), (None, "no id here"), (3, "another text of item three")]
    docs = [(100, None), (101, ""), (102, "--"), (103, "long " * 30_000), (104, "NO ID, here")]
    for k in range(60):
        parts = []
        for _ in range(pick.randrange(4)):
            parts.append(" ".join(pick.choice(words) for _ in range(pick.randrange(30))))
            parts.append((pick.choice(items)[1] or "").swapcase() if pick.random() < 0.3 else pick.choice(items)[1] or "")
        docs.append((k, pick.choice([" ", ". ", "\n"]).join(parts)))
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"block_terms": 3}])
def test_decontamination(spark, leaks, limits):
    docs, items = leaks
    bench = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate(docs_frame(spark, docs), bench, **limits)
    want = leak_rows(docs, items)
    assert by_id(got, "n_words", "n_hit", "items") == want
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.items) for r in got.collect())


def test_proximity(spark):
    docs = [(1, "b x a c"), (2, "a b y y y c"), (3, "c b a"), (4, "a b")]
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = decontaminate(docs_frame(spark, docs), bench, size=3, slop=1)
    assert {r.doc_id: r.contaminated for r in got.collect()} == {1: True, 2: False, 3: True, 4: False}


def test_decontamination_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate(docs_frame(spark, [(1, "a b"), (None, "a"), (None, "b c")]), none).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in got) == [("1", 2, 0), ("None", 1, 0), ("None", 2, 0)]
    assert decontaminate(docs_frame(spark, []), none).collect() == []


def test_decontamination_judges_rows(spark):
    bench = spark.createDataFrame([(1, "x y z"), (2, "p q")], "item_id long, text string")
    rows = [(None, "x y z"), (None, "clean"), (None, "a p q"), (7, "x y z p q"), (7, "also clean"), (7, None), (7, "x y")]
    for order in (rows, rows[::-1]):
        got = decontaminate(docs_frame(spark, order).repartition(3), bench).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == [
            ("7", 0, 0, []),
            ("7", 2, 0, []),
            ("7", 2, 0, []),
            ("7", 5, 5, ["1", "2"]),
            ("None", 1, 0, []),
            ("None", 3, 2, ["2"]),
            ("None", 3, 3, ["1"]),
        ]


URLS = {
    "http://A.Example.com/en/1?x=/": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://m.www.example.com/en/x#t": ("m.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
    "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
    "http://x.net/de/": ("x.net", "/de/", None, "allow"),
    "http://x.com": ("x.com", "", None, "allow"),
    "http://net/fr/a://b": ("net", "/fr/a://b", "net/fr/", "block"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://": ("", "", None, "allow"),
    "a://" + "y." * 300 + "com/" + "z" * 9000: ("y." * 300 + "com", "/" + "z" * 9000, "com/", "allow"),
}


@pytest.mark.parametrize("collide", [False, True])
def test_urls(collide, monkeypatch, tmp_path):
    # With one key for all strings only the stored strings tell rules apart.
    if collide:
        monkeypatch.setattr(url_filter, "_key", lambda text: 7)
    rules = {host + path: verdict for verdict, host, path in URL_RULES}
    (tmp_path / "r").write_bytes(url_filter._pack(list(rules.items())))
    array = url_filter.DigestArray(str(tmp_path / "r"))
    hosts, paths = [v[0] for v in URLS.values()], [v[1] for v in URLS.values()]
    found = url_filter.judge(hosts, paths, [array], "allow")
    assert list(zip(*found)) == [v[2:] for v in URLS.values()]


@pytest.mark.parametrize("labels", [100_000])
def test_urls_of_very_many_labels_take_linear_memory(labels, tmp_path):
    import tracemalloc

    (tmp_path / "r").write_bytes(url_filter._pack([("com/", "allow"), ("b.example.com/x", "block")]))
    array = url_filter.DigestArray(str(tmp_path / "r"))
    host = "y." * labels + "b.example.com"
    tracemalloc.start()
    found = url_filter.judge([host, host, "com", "example.com"], ["/x" + "z" * 500_000, "/", "/", "/x"], [array], "allow")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == (["b.example.com/x", "com/", "com/", "com/"], ["block", "allow", "allow", "allow"])
    assert peak < 5_000_000


def test_suffixes():
    assert url_filter.host_suffixes("a.b.c", [1, 2, 3, 4]) == ["c", "b.c", "a.b.c"]
    assert url_filter.host_suffixes("a.b.c.d", [1, 3]) == ["d", "b.c.d"]
    assert url_filter.host_suffixes("", [1, 2]) == [""] and url_filter.host_suffixes("a", []) == []


def test_url_operator(spark):
    rows = [(k, u, "x", "y") for k, u in enumerate(URLS)] + [(None, "http://x.net/es/", "x", "y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = {(r.page_id, *r[1:]) for r in filter_urls(frame, URL_RULES).collect()}
    assert got == {(k, *v) for k, v in enumerate(URLS.values())} | {(None, "x.net", "/es/", "net/es/", "block")}
    assert filter_urls(frame.limit(0), URL_RULES).collect() == []
    assert {r.verdict for r in filter_urls(frame, [], default="block").collect()} == {"block"}


def test_chats(spark):
    pick = random.Random(6)
    rows, chats = [], {}
    for conv in range(80):
        turns = [(t, pick.choice(["user", "assistant", None]), pick.choice(["hi", "a", None, ""])) for t in range(pick.randint(1, 5))]
        rows += [(conv, *t, "x", 1) for t in turns]
        chats[conv] = tuple((r or "unknown", x or "") for _, r, x in turns)
    rows += [(None, 0, "user", "lost", "x", 1), (500, 0, "user", "same", "x", 1), (500, 0, "user", "same", "x", 1)]
    chats[500] = (("user", "same"),) * 2
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h1 string, position int")
    want = {}
    for conv, turns in chats.items():
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in chats.values()):
            want.setdefault(turns, []).append(conv)
    text = lambda turns: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in turns)
    got = sorted((r.conv_id, r.n_turns, r.copies, r.chat) for r in format_chats(frame).collect())
    assert got == sorted((min(c), len(t), len(c), text(t)) for t, c in want.items())
    assert format_chats(frame.limit(0)).collect() == []
