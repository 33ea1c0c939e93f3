"""The pipeline on the smallest supplied tables, and on tables of odd rows."""

import os

import numpy as np
import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    text = " ".join(f"w{k}" for k in range(120))
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (None, text + " more", None, None, None), (3, None, None, None, None), (4, "", "en", "b", 0), (4, "short one", "de", "b", 9), (4, "short one", "de", "b", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not present")
def test_each_stage_hands_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == names, name
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after and after <= before, name
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {d for r in rows for d in r.doc_ids} == before
    assert all(len(np.frombuffer(r.ids, "<u4")) == sum(p.length for p in r.pieces) <= 4096 for r in rows)


def test_odd_rows_pass_every_stage(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd)
        counts.append((name, docs.count()))
    assert dict(counts)["toxicity"] == 7
    assert dict(counts)["line_dedup"] == 6  # the second row is wholly repeated; the nameless one differs in its only line
    assert corpus_pipeline.run(spark, odd).count() >= 1


def test_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, odd).count() == 0
