"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import chat, decontaminate, htmltext, langid, ledger, licenses, mixing, neardup, pii, ruleclassifier
from graphloom.session import table

#: The vocabulary of op5, unless the session's setting ``graphloom.tokenizer`` names another; the driver reads it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.entries_of(table(spark, sf_dir, "documents")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prefix_tree(table(spark, sf_dir, "conversations"), spark.conf.get("graphloom.tokenizer", TOKENIZER))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruleclassifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redactions(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@functools.lru_cache(maxsize=4)
def _ledger(application: str, sf_dir: str) -> DataFrame:
    """The ledger of a folder's documents, evaluated and stored once a session: policies and ablations read it, not the texts."""
    return ledger.record(table(SparkSession.active(), sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.apply_policy(_ledger(spark.sparkContext.applicationId, sf_dir))


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ablations(_ledger(spark.sparkContext.applicationId, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_mix_sources": op3_mix_sources,
    "op4_license_scan": op4_license_scan,
    "op5_chat_prefix_tree": op5_chat_prefix_tree,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_redact_pii": op7_redact_pii,
    "op8_language_id": op8_language_id,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_rules": op10_quality_rules,
    "quality_rule_ablations": quality_rule_ablations,
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op10_quality_rules": ledger.ORACLE,
    "quality_rule_ablations": ledger.ABLATION_ORACLE,
}
