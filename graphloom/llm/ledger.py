"""Quality rules as a ledger of bit masks.

Every rule is evaluated once for each document. The ledger keeps the measurements and one number, ``failures``, whose bit i says that
rule i fails. A policy is a version and a set of rules: it passes a document if ``failures & mask = 0``, so that another policy, or
another version of one, costs no further look at a text: ``record`` stores a ledger, and policies, ablations and the weights that the
mixture uses are taken from it. Ablations, what each rule alone takes away and what would come back without it, come from a count of the distinct masks.

Rules compare integers (three tenths is ``10 * a > 3 * b``), so they give the same on any engine.

Defined results: a null text is an empty one and fails ``empty`` alone; rows without doc_id and repeated rows get a row each; an empty
table gives an empty ledger, and ablations of zero documents; a very long text is counted whole, in arrays; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import stored
from graphloom.llm.measures import MEASURES, SQL, measured

#: Bit i is the i-th rule: it fails where the condition holds. New rules go to the end, so that old ledgers keep their meaning.
RULES = {
    "empty": "n_words = 0",
    "few_words": "n_words < 50 AND n_words > 0",
    "many_words": "n_words > 100000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "15 * n_symbols > word_chars",
    "digits": "3 * n_digits > word_chars AND n_words >= 20",
    "upper_case": "2 * n_upper > word_chars AND n_words >= 5",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3",
    "top_token": "4 * n_top > n_tokens AND n_tokens >= 20",
    "few_different": "n_distinct * n_distinct < 4 * n_tokens AND n_tokens >= 20",
    "no_stop_words": "n_stop = 0 AND n_tokens >= 20",
}
#: Policies by name and version.
POLICIES = {
    "junk_v1": ["empty", "symbols", "upper_case", "repeated_lines", "few_different"],
    "junk_v2": ["empty", "many_words", "short_words", "long_words", "symbols", "digits", "upper_case", "repeated_lines", "top_token", "few_different", "no_stop_words"],
    "strict_v1": list(RULES),
}
CURRENT = "junk_v2"


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def ledger(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, failures, ...)`` with the measurements, for every row; also: columns of docs to keep beside doc_id."""
    bits = " | ".join(f"IF({condition}, {1 << i}L, 0L)" for i, condition in enumerate(RULES.values()))
    return measured(docs, also).withColumn("failures", F.expr(bits)).select("doc_id", *also, "failures", *MEASURES)


def record(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The ledger as a stored table."""
    return stored(ledger(docs, also))


def weight(policy: str = CURRENT) -> Column:
    """How good a document of a ledger is: an eighth for each rule of the policy that fails."""
    return F.expr(f"1D / cast(shiftleft(1L, 3 * bit_count(failures & {mask(policy)}L)) as double)")


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with ``keep``: whether the document passes the policy."""
    return entries.withColumn("keep", F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(entries: DataFrame) -> DataFrame:
    """``(policy, rule, n_docs, n_fail, n_only, n_pass, n_pass_without)`` for every rule of every policy, from a ledger."""
    spark = entries.sparkSession
    patterns = entries.groupBy("failures").agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    rows = spark.createDataFrame([(p, r, mask(p), 1 << list(RULES).index(r)) for p, own in POLICIES.items() for r in own], "policy string, rule string, mask long, bit long")
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    n = F.coalesce(F.col("n"), F.lit(0))
    total = lambda when: F.sum(F.when(when, n).otherwise(0)).cast("long")
    return (
        rows.join(F.broadcast(patterns), F.lit(True), "left")
        .groupBy("policy", "rule")
        .agg(
            F.sum(n).cast("long").alias("n_docs"),
            total(F.col("failures").bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
            total(hit == F.col("bit")).alias("n_only"),
            total(hit == 0).alias("n_pass"),
            total(F.col("failures").bitwiseAND(F.col("mask").bitwiseXOR(F.col("bit"))) == 0).alias("n_pass_without"),
        )
    )


_FAILURES = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(RULES.values()))
ORACLE = f"""
SELECT doc_id, failures, {", ".join(MEASURES)}, failures & {mask(CURRENT)} = 0 AS keep
FROM (SELECT *, ({_FAILURES})::BIGINT AS failures FROM ({SQL}))
"""
#: The ledger with each document's source, as a relation.
WITH_SOURCE = f"SELECT *, ({_FAILURES})::BIGINT AS failures FROM ({SQL})"
_POLICY_ROWS = ", ".join(f"('{p}', '{r}', {mask(p)}, {1 << list(RULES).index(r)})" for p, own in POLICIES.items() for r in own)
ABLATION_ORACLE = f"""
SELECT policy, rule, count(doc_id)::BIGINT AS n_docs, count(*) FILTER (failures & bit <> 0)::BIGINT AS n_fail, count(*) FILTER (failures & m = bit)::BIGINT AS n_only,
  count(*) FILTER (failures & m = 0)::BIGINT AS n_pass, count(*) FILTER (failures & (m - bit) = 0)::BIGINT AS n_pass_without
FROM (VALUES {_POLICY_ROWS}) p(policy, rule, m, bit) LEFT JOIN ({ORACLE}) ON true GROUP BY policy, rule
"""
