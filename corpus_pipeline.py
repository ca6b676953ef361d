"""From raw documents to a mixture for training, stage by stage; part of the subpackage graphloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents:

1. language ID drops the documents whose language isn't recognised;
2. near duplicates: one document of each group stays;
3. decontamination drops documents that hold a passage of the benchmark;
4. PII replaces personal data and secrets in the texts;
5. mixing gives every source the same number of tokens, and weighs documents by the ledger of quality rules: ``copies`` says how often a
   document is used, by how many tokens of its source come before it in the order of sampling.

Defined results, which are those of the operators in order: documents with a null or empty text, or without words, have no language and
go at the first stage, unless fewer than two languages are labelled, when all stay and one empty text is left of them; rows are known by
doc_id and text, so rows without doc_id, and texts that share one, are judged each on its own, and of rows alike in both one stays; a null
source is a source of its own; columns that documents have beside those named here are kept by all stages but the last, whatever
their names; very long texts are read whole; empty tables of documents or of the benchmark give an empty mixture or drop nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, langid, mixing, neardup, pii
from graphloom.session import stored, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.entries_of(docs))


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: A trained classifier, MinHash and boosted trees can't be written in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
