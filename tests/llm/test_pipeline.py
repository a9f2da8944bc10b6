"""The stages on the smallest tables, and the queries' SQL."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from checks.compare import connect, difference
from ridelens.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    with connect(SMALL) as con:
        assert difference(QUERIES[name](spark, SMALL).toPandas(), con.sql(ORACLES[name]).df()) is None


def test_stages_keep_columns_and_whole_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
        if name == "exact_dedup":
            found = [hashlib.sha256(r.text.encode().lower()).digest() for r in kept.collect()]
            assert len(found) == len(set(found))
    result = corpus_pipeline.run(spark, SMALL).collect()
    assert result and all(r.decodes and r.text == texts[r.doc_id] for r in result)


ODD = "doc_id long, text string, lang string, source string, n_chars long, copies int, copy int, _copies int, coded string, _coded string, text_sha256 string"


def _odd_docs(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    pairs = [(1, "A plain text."), (2, "a PLAIN text."), (2, "Another text of two."), (3, None), (4, ""), (5, long), (6, long + " end"), (None, "a plain text."), (None, None), (7, "Seven."), (7, "Seven.")]
    return spark.createDataFrame([(i, t, "en", "s", 0, 5, 6, 7, "x", "y", "z") for i, t in pairs], ODD)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows_and_clashing_names(spark, name, stage):
    docs = _odd_docs(spark)
    assert stage(spark, docs.limit(0), SMALL).count() == 0
    got = stage(spark, docs, SMALL)
    assert [c for c in got.columns if c in docs.columns] == docs.columns
    assert all((r.copies, r.copy, r._copies, r.coded, r._coded, r.text_sha256) == (5, 6, 7, "x", "y", "z") for r in got.collect())
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect())
    whole = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
    if name in ("toxicity", "byte_bpe"):
        assert kept == whole
    elif name == "exact_dedup":
        gone = [(False, 1, "A plain text."), (False, 3, "")]
        assert kept == [r for r in whole if r not in gone]
    elif name == "ngram_join":
        assert not [r for r in kept if r not in whole] and {r[1] for r in whole} - {r[1] for r in kept} <= {1, 3, 4, 5}
    else:
        assert set(kept) <= set(whole) and [r for r in kept if r[0]] == [r for r in whole if r[0]]
