"""Stages keep all columns of the documents, also those named as the operators name their own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
NAMES = ["__gone", "n_words", "n_removed", "__key", "__p", "__n", "__score", "__words", "__removed", "component_id", "fp", "item_id", "n_item", "s", "d", "j", "score", "toxic", "key", "part", "N_Words2"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_stay(spark, stage):
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = base.where("length(text) < 3000").limit(60).withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in NAMES})
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, DATA)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in NAMES)
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs.where("false"), DATA).collect() == []
