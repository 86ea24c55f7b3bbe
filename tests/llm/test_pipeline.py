"""The pipeline, stage by stage, against brute force on what each stage was given."""

import corpus_pipeline as pipeline
import pytest
from brute_llm import fingerprint, leak_rows, lined, near_components, removed_units, sha
from drawlake.llm.quality import score_quality, train_quality
from pyspark.sql import functions as F
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Name to (input rows, output rows)."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, small).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs.collect(), after.collect()
        if name != "tokens":
            assert after.columns == docs.columns
        docs = after
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_quality(spark, small, stages):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = {r.doc_id for r in score_quality(docs, train_quality(docs, labels)).collect() if r.predicted}
    before, after = map(texts, stages["quality"])
    assert after == {i: t for i, t in before.items() if i in kept}


def test_lines(stages):
    before, after = map(texts, stages["lines"])
    cut = removed_units(before.items(), lined, "\n", 3)
    assert after == {i: kept if gone else before[i] for i, (n, gone, kept) in cut.items() if not gone or gone < n}
    assert all(r.n_chars == len(r.text) for r in stages["lines"][1] if r.text != before[r.doc_id])


def test_near_dedup(stages):
    before, after = map(texts, stages["near_dedup"])
    root = near_components({i: fingerprint(t) for i, t in before.items()})
    assert after == {i: t for i, t in before.items() if root[i] == i}


def test_leaks(spark, small, stages):
    before, after = map(texts, stages["leaks"])
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i for i, _, hit, _ in leak_rows(before.items(), items) if not hit}
    assert after == {i: t for i, t in before.items() if i in clean}


def test_tokens(stages):
    before, after = stages["tokens"]
    library = Tokenizer.from_file(pipeline.VOCABULARY)
    for row in after:
        text = texts(before)[row.doc_id]
        assert row.ids == library.encode(text or "", add_special_tokens=False).ids
        assert row.decoded_sha256 == sha(text or "") and row.ids_sha256 == sha(",".join(map(str, row.ids)))
    assert len(after) == len(before)


def test_run_equals_the_stages(spark, small, stages):
    assert {r.doc_id: r.ids_sha256 for r in pipeline.run(spark, small).collect()} == {
        r.doc_id: r.ids_sha256 for r in stages["tokens"][1]
    }


def test_odd_rows_pass_every_stage(spark, small, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (1, None, "en", "s", None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, small)
            docs.collect()


def test_clashing_columns_pass_every_stage(spark, small):
    extra = ["kept", "n_lines", "n_removed", "found", "items", "score", "predicted", "component_id", "cut_id", "hashes"]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    wide = docs.select("*", *[F.lit(c).alias(c) for c in extra])
    for name, stage in pipeline.STAGES[:-1]:
        plain = {r.doc_id: r.text for r in stage(spark, docs, small).collect()}
        full = stage(spark, wide, small)
        assert full.columns == wide.columns
        rows = full.collect()
        assert {r.doc_id: r.text for r in rows} == plain and all(r[c] == c for r in rows for c in extra), name
    assert pipeline.STAGES[-1][1](spark, wide, small).count() == 60


def test_rows_that_share_ids_pass_every_stage(spark, small):
    from brute_llm import removed_rows

    rows = [(1, "a\nb\nc\nd1\ne1\nf1"), (1, "x\na\nb\nc\ny\nz"), (0, "a\nb\nc"), (None, "a\nb\nc\nq"), (1, None), (2, "")]
    rows += [(1, "some text of five words"), (None, "some text of five words"), (7, "some text of five words")]
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    leaked = max(items, key=len)
    rows += [(1, f"before {leaked} after"), (None, leaked + " once more"), (None, "nothing of a benchmark")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, carried string"
    docs = spark.createDataFrame([(i, t, f"l{k}", "s", len(t or ""), k, "c") for k, (i, t) in enumerate(rows)], schema)
    stage = dict(pipeline.STAGES)

    got = stage["lines"](spark, docs.repartition(3), small)
    assert got.columns == docs.columns
    want = [(i, kept) for i, n, gone, kept in removed_rows(rows, lined, "\n", 3) if not gone or gone < n]
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted(want, key=str)
    assert {r.row for r in got.collect() if r.text is None} == {4}

    got = stage["leaks"](spark, docs.repartition(2), small).collect()
    assert {r.row for r in got} == {k for k, (_, t) in enumerate(rows) if leaked not in (t or "")}

    got = stage["near_dedup"](spark, docs.repartition(2), small).collect()
    alike = [r for r in got if r.text == "some text of five words"]
    assert [r.doc_id for r in alike] == [1]
    assert len({r.text or "" for r in got}) == len(got)
    got = stage["quality"](spark, docs, small).collect()
    assert len({r.row for r in got}) == len(got) <= len(rows)
