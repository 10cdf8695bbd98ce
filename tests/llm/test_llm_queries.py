"""The registered queries against their SQL, and the pipeline end to end."""

import pytest
from oracle import compare, connect

import corpus_pipeline
from spanloom.llm.queries import WORKLOADS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(WORKLOADS))
def test_query(spark, name):
    query, sql = WORKLOADS[name]
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        assert compare(spark, connect(SF), query, sql, SF) is None


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = WORKLOADS["op8_language_id"][0](spark, SF).filter("held_out").join(docs, "doc_id")
    assert out.filter("lang = lang_pred").count() >= 0.97 * out.count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        if name != "packing":
            assert now.columns == docs.columns
            seen.append({r.doc_id for r in now.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:])) and len(seen[-1]) > 0.6 * docs.count()
    assert {r.doc_id for r in now.select("doc_id").collect()} == seen[-1]
    leaked = {r.doc_id for r in WORKLOADS["op9_decontamination"][0](spark, SF).collect()}
    assert leaked and not leaked & seen[-1]


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (None, "the same line of text", "en", "s", 1), (2, "", None, None, None), (3, "one text here", "en", "s", 1), (3, "one text here", "en", "s", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    for docs in (spark.createDataFrame([(*r, 1) for r in rows], kind), spark.createDataFrame([], kind)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() in (0, 2)
