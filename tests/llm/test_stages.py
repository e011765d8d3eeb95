"""Stages of the pipeline: nulls, empty and long texts, repeats, empty tables, and further columns of any name."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

LONG = "wort " * 30_000 + "ende"
PASSAGE = "The quick brown fox jumps over the lazy dog and runs far away today"
ROWS = [(0, PASSAGE, "a"), (1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (4, LONG, "b"), (5, PASSAGE + " again and again", "a"), (5, PASSAGE + " again and again", "a"), (None, PASSAGE, None), (None, None, None), (6, "é😀", "c"), (7, "one\ntwo\r\n\nthree", "c")]
KIND = "doc_id long, text string, source string"
CLASHES = ["__x", "kept", "n_lines", "found", "tail", "__d", "__found", "regs", "component_id", "n_hit", "column_4", "pii", "Expected_Grade"]


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """Small labels and benchmark beside the documents."""
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(0, 1, 0), (4, 0, 0), (6, None, None), (None, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind occurs in these few documents at all, ever"), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("n_chars", [True, False])
def test_stage_keeps_the_callers_columns(spark, place, name, stage, n_chars):
    docs = spark.createDataFrame(ROWS, KIND)
    if n_chars:
        docs = docs.withColumn("n_chars", F.length("text").cast("int"))
    plain = docs
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.struct(F.lit(i).alias("i"), F.col("doc_id").alias("d")))
    got, want = stage(spark, docs, place), stage(spark, plain, place)
    if name == "mix":  # returns its own columns beside those of the caller
        assert {"doc_id", "source", "kept", "found"} <= set(got.columns)
        docs, got = docs.select("doc_id", "kept", "found"), got.select("doc_id", "kept", "found")
    else:
        assert got.schema == docs.schema
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, want.collect()))
    rows = got.collect()
    assert rows and all(r[c].i == CLASHES.index(c) and r[c].d == r.doc_id for r in rows for c in got.columns if c in CLASHES)
    assert stage(spark, docs.limit(0) if name != "mix" else plain.limit(0), place).count() == 0


def test_stages_decide(spark, place):
    docs = spark.createDataFrame(ROWS, KIND)
    by = {name: stage for name, stage in corpus_pipeline.STAGES}
    key = lambda df: sorted((str(r.doc_id), str(r.text)[:40]) for r in df.collect())
    # null comes first in the order of documents, so its passage stays; blank documents have nothing to lose
    assert key(by["lines"](spark, docs, place)) == sorted((str(d), str(t)[:40]) for d, t, _ in ROWS if d != 0)
    assert key(by["near_copies"](spark, docs, place)) == key(docs)
    hit = docs.withColumn("text", F.when(F.col("doc_id") == 6, "x nothing of the kind occurs in these few documents at all, ever!").otherwise(F.col("text")))
    assert [r.doc_id for r in hit.exceptAll(by["decontaminate"](spark, hit, place)).collect()] == [6]
    assert {r.doc_id for r in by["mix"](spark, docs, place).collect()} <= {0, 4, 5, 6, 7, None}
