"""The two classifiers: held-out accuracy, and defined results for odd rows."""

import duckdb
import numpy as np
import pytest
from brute_llm import docs_frame
from drawlake.llm import quality, toxicity
from drawlake.llm.common import utf8
from drawlake.llm.queries import op9_quality, op10_toxicity

BIG = "/root/testdata/sf0.1"


def held_out(spark, query, column):
    labels = dict(duckdb.sql(f"SELECT doc_id, {column} FROM '{BIG}/labels.parquet'").fetchall())
    rows = [r for r in query(spark, BIG).select("doc_id", "held_out", "score", "predicted").collect()]
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    return [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]


def test_quality_held_out(spark):
    found = held_out(spark, op9_quality, "quality")
    assert sum(a == b for a, b in found) / len(found) > 0.97
    # Clean documents stay.
    assert sum(b for a, b in found if a) / sum(a for a, _ in found) > 0.99


def test_toxicity_held_out(spark):
    found = held_out(spark, op10_toxicity, "toxic")
    assert sum(a == b for a, b in found) / len(found) > 0.95
    assert sum(b for a, b in found if not a) / sum(1 - a for a, _ in found) < 0.01


def test_pairs_by_the_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    rows = quality.Rows(np.array([0, 4]), np.array([3, 9, 20, 7], np.int32), rng.random(4).astype(np.float32))
    model = quality.FactorisationMachine(
        0.1, rng.random(quality.FEATURES).astype(np.float32), rng.random((quality.FEATURES, 4)).astype(np.float32)
    )
    x, c = rows.values, rows.columns
    pairs = sum(model.vectors[c[i]] @ model.vectors[c[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert np.isclose(model.logits(rows)[0], 0.1 + model.weights[c] @ x + pairs, rtol=1e-4)


def test_noisy_or_learns_sentences_from_document_labels():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts, labels = [], []
    for k in range(300):
        sentences = [" ".join(f"w{rng.integers(40)}" for _ in range(6)) for _ in range(5)]
        labels.append(k % 3 == 0)
        if labels[-1]:
            sentences[rng.integers(5)] += " vile"
        texts.append(". ".join(sentences))
    data, offsets = utf8(pa.array(texts))
    found = toxicity.sentences(data, offsets)
    model = toxicity.fit(found.features, found.features_at, found.at, np.array(labels, float))
    scores = toxicity.sigmoid(model.logits(found.features, found.features_at))
    bad = np.array([b"vile" in bytes(data[a:b]) for a, b in zip(found.opens, found.closes)])
    assert scores[bad].min() > 0.7 and scores[~bad].max() < 0.3


ROWS = [(1, None), (2, ""), (3, "..."), (4, "a word"), (4, "a word"), (None, "a word"), (5, "x" * 200_000), (6, "word. " * 30_000)]


def test_odd_rows(spark):
    docs = docs_frame(spark, ROWS)
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, None), (9, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for train, score in ((quality.train_quality, quality.score_quality), (toxicity.train_toxicity, toxicity.score_toxicity)):
        for known in (labels, labels.limit(0)):
            got = score(docs, train(docs, known)).collect()
            assert len(got) == len(ROWS)
            assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
            assert [r.held_out for r in got if r.doc_id is None] == [False]
            assert len({r.score for r in got if r.doc_id == 4}) == 1
        assert score(docs.limit(0), train(docs.limit(0), labels)).collect() == []


def test_offending_sentences_are_located(spark):
    weights = np.zeros(1 << toxicity.WORD_BITS, np.float32)
    import pyarrow as pa

    data, offsets = utf8(pa.array(["vile"]))
    weights[toxicity.sentences(data, offsets).features] = 12
    text = "Él ok.\nSo VILE, no? Fine"
    row = toxicity.score_toxicity(docs_frame(spark, [(1, text)]), toxicity.SentenceModel(-6.0, weights)).first()
    assert [text.encode()[s.start : s.end].decode() for s in row.offending] == ["So VILE, no"]
    assert row.predicted == 1


def bucket(word, bits):
    """Hash bucket of one word's bytes."""
    from drawlake.llm.common import word_hashes

    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0] >> np.uint64(64 - bits))


def plain(raw):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


TEXTS = ["", "!!", "One two, one ONE.\n", "Größe | 12 34\n\nx\ty", "a a a b b", "word. " * 300, "€uro $5 {x} [y] <z>", "x" * 5000]


def test_quality_features_word_by_word():
    import math
    import re
    from collections import Counter

    import pyarrow as pa

    chars = np.array([7, 0, 3, 1 << 40, 5, 6, 7, 8])
    rows = quality.features(*utf8(pa.array(TEXTS)), chars)
    for k, text in enumerate(TEXTS):
        raw = text.encode()
        words = [plain(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)]
        want = {bucket(w, quality.WORD_BITS): 0.0 for w in words}
        for word, times in Counter(words).items():
            want[bucket(word, quality.WORD_BITS)] += times / len(words)
        some = max(len(words), 1)
        kinds = Counter(int(quality.KIND[b]) for b in raw)
        numbers = [
            *((1000 * kinds[c] / max(len(raw), 1), 2) for c in range(1, quality.KINDS)),
            (len(raw), 1),
            (len(words), 1),
            ((len(raw) - kinds[3] - kinds[4]) / some, 4),
            (1000 * len(want) / some, 2),
            (len(raw) / (kinds[4] + 1), 2),
            (1000 * sum(a == b for a, b in zip(words, words[1:])) / some, 2),
            (int(chars[k]), 1),
        ]
        for place, (value, scale) in enumerate(numbers):
            bin_ = int(min(math.log2(1 + value) * scale, quality.BINS - 1))
            want[(1 << quality.WORD_BITS) + place * quality.BINS + bin_] = 1.0
        own = slice(rows.bounds[k], rows.bounds[k + 1])
        got = dict(zip(rows.columns[own].tolist(), rows.values[own].tolist()))
        assert set(got) == set(want) and all(math.isclose(got[c], v, rel_tol=1e-6) for c, v in want.items()), text


def test_quality_score_is_the_sum_over_all_pairs(spark):
    rng = np.random.default_rng(2)
    model = quality.FactorisationMachine(
        -0.2, rng.normal(0, 0.3, quality.FEATURES).astype(np.float32), rng.normal(0, 0.2, (quality.FEATURES, 4)).astype(np.float32)
    )
    import pyarrow as pa

    lengths = np.array([len(t) for t in TEXTS])
    rows = quality.features(*utf8(pa.array(TEXTS)), lengths)
    got = {r.doc_id: r.score for r in quality.score_quality(docs_frame(spark, list(enumerate(TEXTS))), model).collect()}
    for k in range(len(TEXTS)):
        own = slice(rows.bounds[k], rows.bounds[k + 1])
        c, x = rows.columns[own], rows.values[own].astype(float)
        z = model.bias + sum(model.weights[i] * v for i, v in zip(c, x))
        for a in range(len(c)):
            for b in range(a):
                z += float(model.vectors[c[a]].astype(float) @ model.vectors[c[b]].astype(float)) * x[a] * x[b]
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-4


def test_toxicity_score_is_the_noisy_or_of_its_sentences(spark):
    import re

    rng = np.random.default_rng(3)
    weights = rng.normal(0, 0.8, 1 << toxicity.WORD_BITS).astype(np.float32)
    model = toxicity.SentenceModel(-1.5, weights)
    texts = [None, *TEXTS, "First one here. Second, LONGERWORDS! third?\nfourth… still fourth. ", "a.b.c", "über schön. Ärger"]
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs_frame(spark, list(enumerate(texts))), model).collect()}
    for k, text in enumerate(texts):
        clean, marked = 1.0, 0
        for sentence in re.split(rb"[.!?\n]", (text or "").encode()):
            words = [plain(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)]
            if not words:
                continue
            parts = [p for w in words for p in (w, *(w[:n] for n in toxicity.BEGINNINGS if len(w) > n))]
            z = model.bias + sum(float(weights[bucket(p, toxicity.WORD_BITS)]) for p in parts)
            p = 1 / (1 + np.exp(-z))
            clean *= 1 - p
            marked += p >= 0.5
        assert abs(got[k].score - (1 - clean)) < 1e-6, text
        assert len(got[k].offending) == marked and got[k].predicted == (got[k].score >= 0.7)


def test_samples_are_bounded_in_rows_and_bytes(spark):
    from drawlake.llm.labelled import labelled_sample

    docs = spark.range(20_000).selectExpr("id % 4 AS doc_id", "IF(id % 4 = 1, 'other', repeat('x', 100)) AS text", "id AS n_chars")
    docs = docs.unionByName(spark.createDataFrame([(5, "y" * 100_000, 0)], docs.schema))
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    sample = lambda **k: labelled_sample(docs, labels, "quality", F.lit(True), **k).collect()
    rows = sample(most=100)
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3, 5] and all(r.label == r.doc_id % 2 for r in rows)
    assert len(sample(most=1)) <= 1
    assert sum(len(r.text) for r in sample(most=100, most_bytes=250)) <= 250
    assert len(labelled_sample(docs.limit(0), labels, "quality", F.lit(True), most=9).collect()) == 0
