"""The pipeline: each stage does its own work on what the one before kept."""

import hashlib

import corpus_pipeline as cp
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from stereoloom.llm import decontaminate, near_dedup, queries


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for i, (_, f) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(spark, stages):
    want = spark.read.parquet(f"{DATA}/documents.parquet").schema
    for df in stages[:-1]:
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in want]
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {r.doc_id for r in stages[0].collect()}
    rows = labels.collect()
    good, bad = [r.doc_id for r in rows if r.quality == 1], [r.doc_id for r in rows if r.quality == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.5 * len(bad)  # seven bad rows teach here; tests of the operator use a larger table


def test_line_dedup_keeps_every_document(stages):
    assert {r.doc_id for r in stages[0].collect()} == {r.doc_id for r in stages[1].collect()}
    assert all(r.n_chars == len(r.text) for r in stages[1].collect())


def test_one_document_of_each_class_stays(spark, stages):
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(stages[1]).collect()}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(classes.values()))


def test_one_row_of_each_class_stays_when_ids_repeat(spark):
    a, b, d = ("these words are one of the texts " + x for x in ("about apples and so on", "about pears and so on", "about plums and so on"))
    rows = [(1, a), (1, a), (1, b), (2, b), (2, d), (None, a), (None, d), (None, d), (3, None), (3, None), (None, "")]
    rows += [(None, "a text of its own under no id"), (None, "a text of its own under no id"), (None, "another text with no id here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.drop_near_duplicates(spark, docs, DATA).collect()
    want = [(1, a), (1, b), (2, d), (3, None), (3, None), (None, ""), (None, "a text of its own under no id"), (None, "another text with no id here")]
    assert sorted(map(str, [(r.doc_id, r.text) for r in got])) == sorted(map(str, want))


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_hostile_and_empty_tables(spark, name):
    """Nulls in any column, empty and long texts, repeated rows, columns that clash with a stage's own."""
    stage = dict(cp.STAGES)[name]
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id but some words", None, "s", 20), (3, "long text of words " * 20_000, "en", "s", 380_000), (4, "twice the same", "en", "s", 14), (4, "twice the same", "en", "s", 14), (5, "\x00 odd \x7f é 日本", "fr", "t", 12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit(1) for c in ("score", "predicted", "grp", "leaf", "content", "code", "row", "label", "bucket", "text_", "n_tokens")}
    got = stage(spark, spark.createDataFrame(rows, schema).withColumns(clash), DATA)
    ids = sorted(str(r.doc_id) for r in got.collect())
    every = sorted(str(r[0]) for r in rows)
    if name == "minhash near-dedup":
        assert ids == sorted(set(every))
    elif name == "quality classifier":
        assert set(ids) <= set(every) and ids.count("4") in (0, 2)
    else:
        assert ids == every
    assert stage(spark, spark.createDataFrame([], schema), DATA).count() == 0
    if name != "byte-level bpe":
        assert got.columns == cp.COLUMNS


def test_no_benchmark_is_left(spark, stages):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.contamination(stages[3], bench).count() == 0
    gone = {r.doc_id for r in stages[2].collect()} - {r.doc_id for r in stages[3].collect()}
    assert gone == {r.doc_id for r in decontaminate.contamination(stages[2], bench).collect()} and gone


def test_tokens_decode_to_the_text(stages):
    text = {r.doc_id: r.text or "" for r in stages[3].collect()}
    assert {r.doc_id: r.decoded_sha256 for r in stages[4].collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in text.items()}


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(queries.pipeline(spark, DATA).collect()) == sorted(stages[-1].collect())
