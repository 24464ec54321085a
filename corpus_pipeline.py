"""The corpus pipeline: stages that each take the documents their predecessor kept.

All stages treat null texts as empty, take repeated and null ids as rows of their own, give an empty
result for an empty table, and (but for the last) keep all columns, whatever their names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import Workspace, free_name, keyed
from tracewright.llm.decontamination import drop_contaminated
from tracewright.llm.near_copies import near_groups
from tracewright.llm.packing import pack
from tracewright.llm.substring import drop_repeated_words
from tracewright.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; null and empty texts stay."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (SimHash at radius 4, or a 5-word-shingle Jaccard similarity of 0.8
    or more) the document with the smallest id stays (of repeated or null ids, one row; texts without
    words are one group)."""
    (key,) = free_name(docs, "__key")
    own = keyed(docs, Workspace(spark, "simhash-stage"), "doc_id", "text", key)
    groups = near_groups(own.select(key, "text"), id_col=key)
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key))
    return own.join(first, key, "left_semi").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go; ``n_chars`` follows the text. A document stays even if nothing of
    it is left."""
    cut = drop_repeated_words(docs, counts=tuple(free_name(docs, "__words", "__removed")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none, null and repeated items are one."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of training sequences, with their ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained scores and packing have no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again."""
    work = Workspace(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
