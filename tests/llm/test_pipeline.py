"""The pipeline: stages in order, columns kept, decisions taken over."""

from __future__ import annotations

import corpus_pipeline
from attesto.llm.queries import read
from attesto.llm.scratch import stage

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, FOLDER, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, FOLDER), name.replace(" ", "-"))
        assert docs.columns == columns
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and after
        before = after
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).select("doc_id").collect()} == before
